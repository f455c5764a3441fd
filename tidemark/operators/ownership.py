"""Holders of a company from JSON arrays: names typed by ordered rules, owner features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOLDERS = "array<struct<name:string,ratio:double>>"


def name_type(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The type of the first rule (pattern, type) that the upper-case, half-width name matches; UNKNOWN for none."""
    clean = F.upper(F.regexp_replace(F.translate(name, "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "), r"\s+", " "))
    out = None
    for pattern, kind in rules:
        held = clean.rlike(pattern)
        out = F.when(held, kind) if out is None else out.when(held, kind)
    return F.coalesce(out.otherwise("UNKNOWN"), F.lit("UNKNOWN"))


#: Rules in order of priority.
RULES = [
    (r"CUSTOD|STATE STREET|BANK OF NEW YORK|NOMINEE", "CUSTODIAN"), (r"TRUST BANK|MASTER TRUST", "TRUST_BANK"), (r"EMPLOYEE|STOCK OWNERSHIP", "EMPLOYEES"), (r"INSURANCE", "INSURANCE"), (r"\bBANK\b", "BANK"),
    (r"ASSET|CAPITAL|FUND|INVESTMENT", "ASSET_MGMT"), (r"SECURITIES", "SECURITIES"), (r"CO\.|LTD|INC|CORP|HOLDINGS|K\.K\.", "COMPANY"), (r"MINISTRY|CITY OF|PREFECTURE", "PUBLIC"), (r"SUPPLIER#|^[A-Z]+ [A-Z]+$", "INDIVIDUAL"),
]


def holders(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """A row for each holder in the JSON array, with its place; null, empty and malformed arrays have none."""
    return df.select(*keys, F.posexplode(F.from_json(json, HOLDERS)).alias("place", "h")).select(*keys, "place", F.col("h.name").alias("name"), F.col("h.ratio").alias("ratio"))


def owner_features(df: DataFrame, keys: list[str], json: str, kind: Column, famous_at: int) -> DataFrame:
    """real_top (first holder that no custodian stands for), owners and their share, famous (an individual known from
    ``famous_at`` companies or more)."""
    h = holders(df, keys, json).withColumn("kind", kind)
    known = h.where("kind = 'INDIVIDUAL'").groupBy("name").agg(F.count_distinct(*keys).alias("companies")).where(F.col("companies") >= famous_at).select("name", F.lit(True).alias("famous"))
    h = h.join(known, "name", "left")
    owner = F.col("kind").isin("INDIVIDUAL", "ASSET_MGMT")
    real = ~F.col("kind").isin("TRUST_BANK", "CUSTODIAN", "UNKNOWN")
    return h.groupBy(*keys).agg(F.min_by(F.when(real, F.col("name")), F.when(real, F.col("place"))).alias("real_top"), F.count_if(owner).alias("owners"), F.coalesce(F.sum(F.when(owner, F.col("ratio"))), F.lit(0.0)).alias("owner_ratio"), F.coalesce(F.bool_or("famous"), F.lit(False)).alias("famous"))


def single_company_names(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Holders that are named by one company alone, with that company."""
    h = holders(df, keys, json)
    return h.groupBy("name").agg(F.count_distinct(*keys).alias("companies"), *(F.min(k).alias(k) for k in keys), F.max("ratio").alias("ratio")).where("companies = 1").drop("companies")
