"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .common import table


def op1_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark, sf_dir):
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op3_secret_scan(spark, sf_dir):
    from .secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"), owner_col="source", repository_cols=("source", "lang"))


def op4_quality(spark, sf_dir):
    from .common import fold_bucket
    from .quality import quality

    bucket = fold_bucket(F.col("_label_id"), 5)
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable=bucket != 0, fitting=bucket != 4)
    return scored.select("doc_id", (fold_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op5_main_text(spark, sf_dir):
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_toxicity(spark, sf_dir):
    from .common import fold_bucket
    from .toxicity import toxicity

    bucket = fold_bucket(F.col("_label_id"), 4)
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable=bucket != 2, calibrating=bucket == 3)
    return scored.select("doc_id", (fold_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_token_counts(spark, sf_dir):
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), limit=1024)


def op8_source_mix(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark, sf_dir):
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    from .conversations import conversation_reports, damaged

    turns = table(spark, sf_dir, "conversations")
    return conversation_reports(damaged(turns), turns)


def op12_itemsets(spark, sf_dir):
    from .itemsets import closed_itemsets

    sets = closed_itemsets(table(spark, sf_dir, "sale_lines"))
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    listed = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"].cast("string"), r["a"].cast("string"), r["s"].cast("string"))), ";")
    items = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("items", "n_items"), ("rules", "n_rules"))]
    return sets.select(items.alias("items"), sizes[0], "support", sizes[1], best.alias("best_item"), F.sha2(listed.cast("binary"), 256).alias("rules_sha256"))


#: The rules that the contract names: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_filter(spark, sf_dir):
    from .hosts import judged_urls

    return judged_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op1_exact_dedup": oracles.EXACT, "op3_secret_scan": oracles.SECRETS, "op8_source_mix": oracles.MIX, "op9_decontamination": oracles.PHRASES, "op10_near_dedup": oracles.NEAR, "op11_conversation_repair": oracles.REPAIR, "op12_itemsets": oracles.BASKETS, "op13_url_filter": oracles.URLS}
