"""The named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import addresses, canonical, mixing, overlap, packing, quotas, residue, splits
from docweave.llm.sql import SQL
from docweave.session import cut, spread
from docweave.sources.tables import table


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(splits.records(table(spark, folder, "kie_split"))).select("test_id", "group_test_id", "split")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return splits.report(splits.assign(splits.records(table(spark, folder, "kie_split"))))


def p1_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return splits.invariants(splits.assign(splits.records(table(spark, folder, "kie_split"))))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.straddling(splits.assign(splits.records(table(spark, folder, "kie_split"))))


def _texts(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str, str]]:
    cells = table(spark, folder, "line_cells").where("field = 'description'")
    return {"text": (table(spark, folder, "transcriptions"), "transcript_id", "text"), "raw_text": (cells, "cell_id", "raw_text")}


def p2_consistent(spark: SparkSession, folder: str) -> DataFrame:
    made = [canonical.both_forms(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), "text").select(F.lit(field).alias("field"), "id", "written", "plain") for field, (rows, key, text) in _texts(spark, folder).items()]
    return made[0].unionByName(made[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    made = [canonical.alike(rows, key, text).select(F.lit(field).alias("field"), "id_a", "id_b") for field, (rows, key, text) in _texts(spark, folder).items()]
    return made[0].unionByName(made[1])


def _quota_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("test_manifest", "candidate_pool", "stratum_targets")]


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.sample(*_quota_tables(spark, folder))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return quotas.report(*_quota_tables(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_report(spark, folder).where("shortfall > 0").select("plan_name", "category")


def p4_locations(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.locations(table(spark, folder, "invoice_headers"), table(spark, folder, "city_aliases"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return addresses.same_location(p4_locations(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found(table(spark, folder, "test_manifest"), table(spark, folder, "candidate_pool"))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.links(table(spark, folder, "test_manifest"), table(spark, folder, "candidate_pool"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(p5_links(spark, folder), table(spark, folder, "test_manifest"), table(spark, folder, "kie_split"))


def _texts_of(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *more))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_texts_of(spark, folder), table(spark, folder, "pack_plans"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(p7_packed(spark, folder), table(spark, folder, "pack_plans"))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return packing.invariants(p7_packed(spark, folder), table(spark, folder, "pack_plans"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.split_texts(p7_packed(spark, folder))


def _mixture(spark: SparkSession, folder: str, feasible: bool = False) -> tuple[DataFrame, DataFrame]:
    sized = cut(mixing.sizes(_texts_of(spark, folder, "source")))
    rated = mixing.rates(sized, table(spark, folder, "mix_targets"), feasible)
    return mixing.mix(sized, rated), rated


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder)[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(*_mixture(spark, folder))


def p8_feasible(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(*_mixture(spark, folder, feasible=True))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.invariants(p8_report(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).where("not reached").select("mix_name", "source")


def p9_judged(spark: SparkSession, folder: str) -> DataFrame:
    return residue.judge(_texts_of(spark, folder)).drop("text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found(_texts_of(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {name: query for name, query in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(SQL)
