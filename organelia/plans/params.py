"""Curation parameters: the built-in sets, overrides, and rules as a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The genes of the built-in sets and what their rules say.
PROTEINS = ("nad1", "nad2", "cox1", "cox2", "atp8", "atp6", "cox3", "nad3", "nad4l", "nad4", "nad5", "nad6", "cob")
TRNAS = "ACDEFGHIKLMNPQRSTVWY"
STOP_MAY_OVERLAP = ("cox1", "atp8", "nad4l", "nad5", "nad6")
START_OVERLAP_20 = ("atp6", "nad4")
TWO_COPIES = ("trnL", "trnS")
FISH_STARTS = ["ATG", "GTG", "ATA", "ATT", "TTA", "ATC"]
FISH_EXTRA_STARTS = {"nad1": "TTG", "cox2": "TTG", "atp6": "CTG"}
FLY_STARTS = ["TTG", "ATT", "ATC", "ATA", "ATG", "GTG"]
STAR_STARTS = ["ATG", "GTG"]
FISH_STOPS = ["TAA", "TAG", "AGA", "AGG", "AG", "TA", "T"]
OTHER_STOPS = ["TAA", "TAG", "TA", "T"]


def merge(base: Mapping[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """Changes laid over a nested base; lists and scalars are replaced, objects merged."""
    out = deepcopy(dict(base))
    for k, v in changes.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else deepcopy(v)
    return out


def _params(group: str, threshold: int, starts: list[str], stops: list[str], extra: Mapping[str, str], changes: Mapping[str, Any]) -> dict[str, Any]:
    rules: dict[str, Any] = {"ctrl": {"type": "ctrl", "count": 1, "min_len": 350}, "rrnL": {"type": "rRNA", "max_len": 1850}, "rrnS": {"type": "rRNA", "max_len": 1000}}
    for gene in PROTEINS:
        rule: dict[str, Any] = {"type": "PCG"}
        if gene in STOP_MAY_OVERLAP:
            rule["overlap"] = {"start": 2, "stop": True}
        if gene in START_OVERLAP_20:
            rule["overlap"] = {"start": 20, "stop": False}
        if gene in extra:
            rule["start_codons"] = [*starts, extra[gene]]
        rules[gene] = rule
    for letter in TRNAS:
        gene = f"trn{letter}"
        rules[gene] = {"type": "tRNA"} | ({"count": 2} if gene in TWO_COPIES else {})
    base = {
        "ref_dbs": {"default": f"/ref_dbs/{group}/{{gene}}.fas"},
        "hit_threshold": threshold,
        "max_overlap": 0.25,
        "default_rules": {
            "rRNA": {"count": 1, "overlap": {"start": 0, "stop": False}},
            "PCG": {"count": 1, "overlap": {"start": 2, "stop": False}, "start_codons": starts, "stop_codons": stops},
            "tRNA": {"count": 1},
        },
        "rules": rules,
    }
    return merge(base, changes)


def fish(changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _params("chordata", 90, FISH_STARTS, FISH_STOPS, FISH_EXTRA_STARTS, changes or {})


def diptera(changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _params("metazoa", 80, FLY_STARTS, OTHER_STOPS, {}, changes or {})


def starfish(changes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    return _params("metazoa", 80, STAR_STARTS, OTHER_STOPS, {}, changes or {})


#: Target name to its parameters and genetic code; more may be registered.
TARGETS: dict[str, tuple[Callable[..., dict[str, Any]], int]] = {"fish": (fish, 2), "diptera": (diptera, 5), "starfish": (starfish, 9)}


def effective_rules(params: Mapping[str, Any]) -> list[dict[str, Any]]:
    """One flat rule per gene: the type's defaults under the gene's own values."""
    out = []
    for gene, own in params["rules"].items():
        r = merge(params["default_rules"].get(own.get("type"), {}), own)
        o = r.get("overlap") or {}
        out.append({"gene": gene, "type": r.get("type"), "count": r.get("count", 1), "max_len": r.get("max_len"), "min_len": r.get("min_len"),
            "overlap_start": o.get("start"), "overlap_stop": o.get("stop"), "start_codons": r.get("start_codons"), "stop_codons": r.get("stop_codons")})
    return out


RULES = "gene string, type string, count int, max_len long, min_len long, overlap_start int, overlap_stop boolean, start_codons array<string>, stop_codons array<string>"


def rules_frame(spark: SparkSession, params: Mapping[str, Any]) -> DataFrame:
    """Rules as a table; of a count that is a list of right numbers the greatest stands."""
    most = lambda c: max(c) if isinstance(c, (list, tuple)) else c
    return spark.createDataFrame([r | {"count": most(r["count"])} for r in effective_rules(params)], RULES)


def merged_rules(values: DataFrame) -> DataFrame:
    """Rules of many sets from shredded values (curate_opts, section, name, field, pos, item): gene rules over the defaults of their type.

    One aggregation over (set, section, name) and one join on (set, type); a set is a few dozen rules.
    """
    one = lambda f: F.max(F.when(F.col("field") == f, F.col("item")))
    listed = lambda f: F.nullif(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "item")))), lambda x: x["item"]),
        F.array().cast("array<string>"))
    flat = values.groupBy("curate_opts", "section",
        "name").agg(*[one(f).alias(f.replace(".", "_")) for f in ("type", "count", "max_len", "min_len", "overlap.start", "overlap.stop")],
        listed("start_codons").alias("start_codons"), listed("stop_codons").alias("stop_codons"))
    cols = ["count", "max_len", "min_len", "overlap_start", "overlap_stop", "start_codons", "stop_codons"]
    own = flat.where("section = 'rules'").drop("section").withColumnRenamed("name", "gene")
    base = flat.where("section = 'default_rules'").select("curate_opts", F.col("name").alias("type"), *[F.col(c).alias(f"d_{c}") for c in cols])
    return own.join(base, ["curate_opts", "type"], "left").select("curate_opts", "gene", "type", *[F.coalesce(c, f"d_{c}").alias(c) for c in cols])
