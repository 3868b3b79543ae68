"""The data workflow end to end: catalogue, sampling plan, compiled units, verification, and training batches.

All units run in one plan with the unit as a column; what the driver holds is the catalogue and one row a unit or file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import hashing
from quern.operators import batching, catalog, checks, corpus, sampling
from quern.session import materialise
from quern.sources import records

SHARD = "source_id string, unit_id string, task_type string, language string, paper_size long, shard_ordinal int, path string, row_start long, row_stop long, n_rows long"


def parse_catalog(text: str) -> dict:
    """A catalogue document in YAML or JSON; schema_version must be 1."""
    try:
        doc = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("catalogues in YAML need the yaml package") from e
        doc = yaml.safe_load(text)
    if doc.get("schema_version") != 1:
        raise ValueError("the catalogue's schema_version must be 1")
    return doc


def catalog_shards(doc: dict) -> list[tuple[str, str, str, int | None, int | None]]:
    """(source_id, unit_id, path, row_start, row_stop) of a catalogue's shards; those without a range have nulls."""
    entries = ((s["source_id"], u["sampling_unit_id"], x if isinstance(x, dict) else {"path": x}) for s in doc["sources"] for u in s["sampling_units"] for x in u["shards"])
    return [(s, u, x["path"], x.get("row_start"), x.get("row_stop")) for s, u, x in entries]


@dataclass
class Selection:
    """What to plan: a profile, the cap and seed (null: the profile's), and units to take in or leave out."""

    profile: str
    limit: int | None = None
    seed: int | None = None
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    only: Sequence[str] = ()
    include_contaminated: bool = False
    person: bytes = b"quern-row"  # personalisation of the rows' ids


def _paths(unit: dict) -> list[str]:
    return [x["path"] if isinstance(x, dict) else x for x in unit["shards"]]


def _row_counts(spark: SparkSession, root: str, paths: list[str]) -> dict[str, int]:
    """Rows of each file by its path below the root: all footers in one job."""
    prefix = records.hadoop_path(spark, root)[0].toUri().getPath().rstrip("/") + "/"
    found = records.inventory(spark, [f"{root}/{p}" for p in paths]).select("uri", "n_rows").collect()
    return {r["uri"].partition(prefix)[2]: r["n_rows"] for r in found}


def bind(spark: SparkSession, doc: dict, root: str, sel: Selection) -> DataFrame:
    """Shards of the profile's sources with their footers' row counts, exclusion status and checked row ranges."""
    profile = doc["profiles"][sel.profile]
    enabled = set(profile["enabled_sources"])
    known = {s["source_id"] for s in doc["sources"]}
    if len(known) != len(doc["sources"]) or enabled - known:
        raise ValueError(f"sources are repeated or unknown: {sorted(enabled - known)}")
    if (n := profile.get("expected_source_count")) is not None and n != len(enabled):
        raise ValueError(f"{len(enabled)} sources, not {n}")
    overrides, rows, units = profile.get("source_unit_overrides") or {}, [], set()
    paths = sorted({hashing.normal_path(p) for s in doc["sources"] if s["source_id"] in enabled for u in s["sampling_units"] for p in _paths(u)})
    counts = _row_counts(spark, root, paths)
    for s in doc["sources"]:
        if s["source_id"] not in enabled:
            continue
        if s["task_type"] not in checks.TASK_TYPES:
            raise ValueError(f"unknown task type {s['task_type']}")
        chosen = overrides.get(s["source_id"], s["sampling_units"])
        flat = lambda us: sorted(json.dumps(x, sort_keys=True) for u in us for x in u["shards"])
        if flat(chosen) != flat(s["sampling_units"]):
            raise ValueError(f"the override of {s['source_id']} doesn't hold the same shards")
        for u in chosen:
            if u["sampling_unit_id"] in units:
                raise ValueError(f"unit {u['sampling_unit_id']} occurs twice")
            units.add(u["sampling_unit_id"])
            for k, shard in enumerate(u["shards"]):
                x = shard if isinstance(shard, dict) else {"path": shard}
                path = hashing.normal_path(x["path"])
                lo, hi = x.get("row_start"), x.get("row_stop")
                if (lo is not None or hi is not None) and not 0 <= (lo or 0) < (counts[path] if hi is None else hi) <= counts[path]:
                    raise ValueError(f"bad row range of {path}")
                rows.append((s["source_id"], u["sampling_unit_id"], s["task_type"], u.get("language", s.get("language")), s.get("paper_size"), k, path, lo, hi, counts[path]))
    if unknown := {*sel.include, *sel.exclude, *sel.only} - units:
        raise ValueError(f"unknown units {sorted(unknown)}")
    shards = spark.createDataFrame(rows, SHARD).withColumn("shard_id", F.monotonically_increasing_id())
    checks.assert_empty(catalog.overlaps(shards), "overlapping shards")
    bad = F.col("source_id").isin(*(profile.get("excluded_contaminated_sources") or [""]))
    shards = catalog.exclusion_status(shards.drop("shard_id"), bad, sel.include_contaminated, list(sel.include), list(sel.exclude), "unit_id")
    return materialise(shards.where(F.col("unit_id").isin(*sel.only)) if sel.only else shards, "shards")


def draw(spark: SparkSession, doc: dict, shards: DataFrame, root: str, sel: Selection) -> DataFrame:
    """The selection index (unit_id, path, row_index, sample_id): at most the cap for each unit, by hash order."""
    profile = doc["profiles"][sel.profile]
    limit, seed = sel.limit or profile["sample_limit"], profile.get("default_seed", 42) if sel.seed is None else sel.seed
    if limit < 0:
        raise ValueError("the cap must not be negative")
    live = shards.where("NOT excluded")
    paths = [r[0] for r in live.select("path").distinct().orderBy("path").collect()]
    if not paths:
        raise ValueError("nothing is selected")
    prefix = records.hadoop_path(spark, root)[0].toUri().getPath().rstrip("/") + "/"
    at = spark.read.parquet(*(f"{root}/{p}" for p in paths)).select(F.regexp_replace(F.expr("parse_url(_metadata.file_path, 'PATH')"), f"^.*?{re.escape(prefix)}", "").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    rows = at.join(live.select("unit_id", "path", "row_start", "row_stop"), "path").where("row_index >= coalesce(row_start, 0) AND row_index < coalesce(row_stop, 9223372036854775807)")
    picked = sampling.capped(rows.select("unit_id", "path", "row_index"), ["unit_id"], F.concat_ws(":", "path", F.col("row_index").cast("string")), limit, seed, sel.profile)
    release = doc["dataset_release_id"]
    return materialise(hashing.with_digest(picked, "sample_id", ["path", "row_index"], lambda p, r: hashing.row_id(release, p, r, sel.person)), "index")


def report(shards: DataFrame, index: DataFrame) -> DataFrame:
    """(task_type, n_sources, n_units, n_active_units, n_rows, n_selected) with a total row (task_type total)."""
    chosen = index.groupBy("unit_id").agg(F.count(F.lit(1)).alias("selected"))
    rows = F.coalesce("row_stop", "n_rows") - F.coalesce("row_start", F.lit(0))
    units = shards.groupBy("task_type", "source_id", "unit_id").agg(F.sum(rows).alias("rows"), F.first("excluded").alias("excluded")).join(chosen, "unit_id", "left")
    out = units.rollup("task_type").agg(F.countDistinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_units"), F.count_if(~F.col("excluded")).alias("n_active_units"), F.sum("rows").alias("n_rows"), F.coalesce(F.sum("selected"), F.lit(0)).alias("n_selected"))
    return out.withColumn("task_type", F.coalesce("task_type", F.lit("total")))


@dataclass
class Compiled:
    queries: DataFrame
    corpus: DataFrame
    manifest: DataFrame


def compile_units(spark: SparkSession, shards: DataFrame, index: DataFrame, root: str, out: str) -> Compiled:
    """Selected rows to queries and corpora with dense ids within each unit, published below out.

    Rows with an empty query or passage are dropped and counted; empty negatives are removed and counted. A unit's texts
    number at most its cap times its columns, which bounds the windows that give ids.
    """
    paths = [r[0] for r in index.select("path").distinct().orderBy("path").collect()]
    raw = spark.read.option("mergeSchema", True).parquet(*(f"{root}/{p}" for p in paths))
    names = corpus.negative_columns(raw.columns)
    lang = F.col("lang") if "lang" in raw.columns else F.lit(None).cast("string")
    prefix = records.hadoop_path(spark, root)[0].toUri().getPath().rstrip("/") + "/"
    rows = raw.select("query", "passage", *names, lang.alias("row_lang"), F.regexp_replace(F.expr("parse_url(_metadata.file_path, 'PATH')"), f"^.*?{re.escape(prefix)}", "").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    rows = corpus.nest_negatives(rows.join(index, ["path", "row_index"]))
    where = shards.where("NOT excluded").select("unit_id", "path", "shard_ordinal", "language", "row_start", "row_stop")
    rows = materialise(rows.join(where, ["unit_id", "path"]).where("row_index >= coalesce(row_start, 0) AND row_index < coalesce(row_stop, 9223372036854775807)"), "selected")
    good = corpus.valid_rows(rows, "query", "passage")
    queries = corpus.dense_ids(good, ["shard_ordinal", "row_index"], "query_id", ["unit_id"])
    texts = queries.select("unit_id", "query_id", F.posexplode(F.concat(F.array("passage"), "negatives")).alias("pos", "text"))
    docs = corpus.dedup(texts.withColumn("seen", F.struct("query_id", "pos")), "text", "seen", ["unit_id"])
    docs = materialise(docs.select("unit_id", "doc_id", "text"), "corpus")
    linked = texts.join(docs, ["unit_id", "text"]).groupBy("unit_id", "query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id"))).alias("d"))
    ids = F.transform("d", lambda x: x["doc_id"])
    # a missing lang column falls back to the unit's language; a null in the column stays null
    language = F.col("row_lang") if "lang" in raw.columns else F.col("language")
    full = queries.join(linked, ["unit_id", "query_id"]).select("unit_id", "query_id", F.unhex("sample_id").alias("sample_id"), F.col("shard_ordinal").alias("source_shard_id"), F.col("row_index").alias("source_row_index"), "query", F.get(ids, F.lit(0)).alias("positive_doc_id"), F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))).alias("negative_doc_ids"), language.alias("lang"))
    records.publish(full, f"{out}/queries")
    records.publish(docs, f"{out}/corpus")
    made = Compiled(spark.read.parquet(f"{out}/queries"), spark.read.parquet(f"{out}/corpus"), rows)
    counts = rows.groupBy("unit_id").agg(F.count(F.lit(1)).alias("selected"), F.sum("n_removed").alias("negatives_removed"))
    counts = counts.join(made.queries.groupBy("unit_id").agg(F.count(F.lit(1)).alias("query_count")), "unit_id", "left")
    counts = counts.join(corpus.fingerprint(made.queries.withColumn("sample", F.hex("sample_id")), ["unit_id"], ["sample"], "sample"), "unit_id", "left")
    counts = counts.join(made.corpus.groupBy("unit_id").agg(F.count(F.lit(1)).alias("corpus_count")), "unit_id", "left").fillna(0, ["query_count", "corpus_count"]).withColumn("dropped", F.col("selected") - F.col("query_count"))
    records.publish(counts, f"{out}/manifest")
    made.manifest = spark.read.parquet(f"{out}/manifest")
    return made


def verify(c: Compiled) -> DataFrame:
    """(unit_id, problem) of every broken invariant: dense ids, references, sample ids, counts. Empty if all hold."""
    docs = c.corpus.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("text").alias("texts"))
    refs = F.concat(F.array("positive_doc_id"), "negative_doc_ids")
    q = c.queries.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("query_id").alias("qlo"), F.max("query_id").alias("qhi"), F.countDistinct("query_id").alias("qids"), F.countDistinct("sample_id").alias("samples"), F.min(F.array_min(refs)).alias("rlo"), F.max(F.array_max(refs)).alias("rhi"))
    j = c.manifest.join(docs, "unit_id", "left").join(q, "unit_id", "left").where("query_count > 0")
    checked = {
        "document ids": "lo = 0 AND hi = n_docs - 1 AND ids = n_docs AND texts = n_docs AND n_docs = corpus_count",
        "query ids": "qlo = 0 AND qhi = n - 1 AND qids = n AND n = query_count",
        "references": "rlo >= 0 AND rhi < n_docs",
        "sample ids": "samples = n",
        "counts": "selected = query_count + dropped",
    }
    problems = F.filter(F.array(*(F.when(~F.coalesce(F.expr(v), F.lit(False)), k) for k, v in checked.items())), lambda x: x.isNotNull())
    return j.select("unit_id", F.explode(problems).alias("problem"))


def batches(c: Compiled, batch_size: int, group_size: int, world_size: int = 1, seed: int = 42, epoch: int = 0, block: int = 1, prompts: Sequence[str] = ()) -> DataFrame:
    """(step, unit_id, position, rank, query, passages): one dataset a step, the positive first, group_size passages each.

    A query without negatives is an error, as is a group of fewer than two.
    """
    if group_size < 2:
        raise ValueError("a group needs two passages")
    checks.assert_empty(c.queries.where("size(negative_doc_ids) = 0").select("unit_id", "query_id"), "queries without negatives")
    plan = batching.plan(c.queries, "unit_id", "query_id", batch_size, seed, epoch)
    steps = batching.steps(plan, "unit_id", seed, epoch, block)
    rows = plan.join(steps, ["unit_id", "batch_ordinal"]).join(c.queries, ["unit_id", "query_id"])
    picked = sampling.choose_many(F.col("negative_doc_ids"), group_size - 1, hashing.seeded(seed, epoch, F.col("unit_id"), F.col("query_id")))
    rows = rows.withColumn("ids", F.concat(F.array("positive_doc_id"), picked)).withColumn("rank", batching.rank_of(F.col("position"), batch_size, world_size))
    rows = rows.withColumn("prompt", batching.instruction(list(prompts), F.col("batch_ordinal"), F.col("position"), batch_size))
    long = rows.select("unit_id", "step", "position", F.posexplode("ids").alias("k", "doc_id")).join(c.corpus, ["unit_id", "doc_id"])
    texts = long.groupBy("unit_id", "step", "position").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("passages"))
    query = F.when(F.col("prompt") == "", F.col("query")).otherwise(F.format_string("Instruct: %s\nQuery: %s", "prompt", "query"))
    return rows.withColumn("query", query).join(texts, ["unit_id", "step", "position"]).select("step", "unit_id", "position", "rank", "query", "passages")


def open_units(sizes: Sequence[str], capacity: int) -> list[tuple[int, str, str | None]]:
    """Least-recently-used simulation over a schedule of unit names: (step, opened, evicted) of each miss."""
    held: dict[str, None] = {}
    out = []
    for step, unit in enumerate(sizes):
        if unit in held:
            held[unit] = held.pop(unit)
            continue
        gone = next(iter(held)) if len(held) >= capacity else None
        if gone is not None:
            del held[gone]
        held[unit] = None
        out.append((step, unit, gone))
    return out


def resume(c: Compiled, doc: dict, sel: Selection, index: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, reason) of units that have to be built again: missing, of another profile, release or selection, or incomplete.

    files (unit_id, file) lists what of each unit is there: queries and corpus are needed.
    """
    of_run = {"profile": F.lit(sel.profile), "release": F.lit(doc["dataset_release_id"])}
    wanted = corpus.fingerprint(index, ["unit_id"], ["sample_id"], "sample_id").withColumns(of_run)
    stored = c.manifest if {"profile", "release", "fingerprint"} <= set(c.manifest.columns) else c.manifest.withColumns(of_run)
    return catalog.stale_units(wanted, stored, files, "unit_id", ["profile", "release", "fingerprint"], ["queries", "corpus"])


def ordered_batches(rows: DataFrame) -> DataFrame:
    """Rows by step and position, whatever order tasks end in: ranges of steps, sorted inside."""
    return rows.repartitionByRange("step", "position").sortWithinPartitions("step", "position")


def query_total_warning(index: DataFrame, expected: int | None) -> str | None:
    """The audit of the total is a warning, unlike that of the sources."""
    n = index.count()
    return None if expected is None or n == expected else f"{n} queries are selected; the catalogue expects {expected}"

