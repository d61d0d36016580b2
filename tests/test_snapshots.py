"""Versioned tables, loads in batches, and streams of them."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from laborlens.operators import dims, enrich, load, quality
from laborlens.sources import snapshots
from laborlens.streaming import ingest

AS_OF = "2001-08-01"
NAMES = "source_site string, source_id string, id long, title string, description string, company_name string, source_url string, language string, salary_min double, salary_max double, arrival int"


def batch(spark, *rows):
    """rows of (source_id, title, arrival)."""
    return spark.createDataFrame([("s", k, int(k), t, None, "c", "https://x.y", "en", 1.0, 2.0, a) for k, t, a in rows], NAMES)


def of(spark, path, schema, number=None):
    return {r.source_id: (r.id, r.title) for r in snapshots.latest(spark, path, schema, number).collect()}


def parts(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("data/*/bucket=*/*.parquet")}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/jobs"


def test_only_touched_buckets_are_rewritten(spark, path, tmp_path):
    many = batch(spark, *((str(k), "first", 1) for k in range(100)))
    schema = load.posting_schema(many.drop("arrival"))
    one = snapshots.merge(spark, path, many, AS_OF, batch=1, buckets=8)
    assert one.counts == {"inserted": 100, "updated": 0} and sorted(one.folders) == list(range(8))
    held = parts(tmp_path / "jobs")
    two = snapshots.merge(spark, path, batch(spark, ("7", "old", 1), ("7", "new", 3), ("7", "mid", 2), ("500", "fresh", 1)), AS_OF, batch=2)
    assert two.counts == {"inserted": 1, "updated": 3}
    changed = {b for b in range(8) if one.folders[b] != two.folders.get(b)}
    assert 1 <= len(changed) <= 2 and held.items() <= parts(tmp_path / "jobs").items()
    rows = of(spark, path, schema)
    assert len(rows) == 101 and rows["7"] == (7, "new") and rows["500"] == (500, "fresh") and rows["8"] == (8, "first")
    # an earlier version is still there until it is vacuumed
    assert of(spark, path, schema, 1)["7"] == (7, "first")
    assert snapshots.vacuum(spark, path, keep=1) == 0  # the first folder still holds untouched buckets
    assert snapshots.versions(spark, path) == [2] and of(spark, path, schema) == rows


def test_a_batch_counts_once(spark, path, tmp_path):
    b = batch(spark, ("1", "a", 1))
    first = snapshots.merge(spark, path, b, AS_OF, batch=5, buckets=4)
    held = parts(tmp_path / "jobs")
    again = snapshots.merge(spark, path, b.withColumn("title", F.lit("other")), AS_OF, batch=5)
    assert again.number == first.number and again.counts == {} and parts(tmp_path / "jobs") == held and snapshots.versions(spark, path) == [1]


def test_a_batch_that_breaks_a_rule_leaves_the_table_as_it_was(spark, path, tmp_path):
    snapshots.merge(spark, path, batch(spark, ("1", "a", 1)), AS_OF, batch=1, buckets=4, strict=True)
    held = parts(tmp_path / "jobs")
    bad = batch(spark, ("2", "fine", 1), ("3", " ", 1)).withColumn("salary_min", F.lit(3.0))
    with pytest.raises(quality.BatchRefused) as refused:
        snapshots.merge(spark, path, bad, AS_OF, batch=2, strict=True)
    assert refused.value.broken == {"title": 1, "salary_order": 2}
    assert parts(tmp_path / "jobs") == held and snapshots.versions(spark, path) == [1]


def test_known_postings_keep_what_no_load_overwrites(spark):
    old = spark.createDataFrame([("s", "1", 10, "t", "d", "c", "u", "de", 1.0, 2.0, "raw")], NAMES.replace("arrival int", "raw_data string")).withColumns({"scraped_date": F.lit("2000-01-01").cast("timestamp"), "is_active": F.lit(False), "is_deleted": F.lit(True)})
    came = batch(spark, ("1", "new", 1), ("2", "other", 1)).withColumns({"company_name": F.lit(None).cast("string"), "source_url": F.lit(None).cast("string")})
    got = {r.source_id: r for r in load.upsert(old, came, AS_OF).collect()}
    assert (got["1"].id, got["1"].title, got["1"].description, got["1"].company_name, got["1"].source_url, got["1"].language, got["1"].raw_data) == (10, "new", "", "Unknown", "", "de", "raw")
    assert got["1"].is_active and not got["1"].is_deleted and (got["2"].id, got["2"].language, got["2"].raw_data) == (2, "en", None)


def test_purging_rewrites_the_buckets_of_old_postings(spark, path, tmp_path):
    rows = batch(spark, *((str(k), "t", 1) for k in range(40))).drop("arrival")
    stamped = rows.withColumns({"scraped_date": F.when(F.col("source_id") == "3", F.lit("2000-01-01")).otherwise(F.lit("2001-07-30")).cast("timestamp"), "is_active": F.lit(True), "is_deleted": F.lit(False)})
    one = snapshots.create(spark, path, stamped, 8)
    two = snapshots.purge(spark, path, stamped.schema, AS_OF, 90)
    assert two.counts == {"purged": 1} and sum(one.folders[b] != two.folders.get(b) for b in range(8)) == 1
    assert "3" not in of(spark, path, stamped.schema) and len(of(spark, path, stamped.schema)) == 39
    assert snapshots.purge(spark, path, stamped.schema, AS_OF, 90).counts == {"purged": 0} and snapshots.versions(spark, path) == [1, 2]


def test_tables_without_rows(spark, path):
    none = batch(spark)
    schema = load.posting_schema(none.drop("arrival"))
    assert snapshots.merge(spark, path, none, AS_OF, batch=1).counts == {"inserted": 0, "updated": 0}
    assert of(spark, path, schema) == {} and snapshots.merge(spark, path, batch(spark, ("1", "a", 1)), AS_OF, batch=2).counts == {"inserted": 1, "updated": 0}


def test_streamed_batches_are_loaded_whole_and_once(spark, tmp_path):
    landing, star = tmp_path / "landing", f"file://{tmp_path}/star"
    landing.mkdir()
    record = lambda k, title, **more: json.dumps({"id": k, "title": title, "company": {"display_name": "c"}, "salary_min": 5, "salary_max": 9} | more)
    (landing / "a.txt").write_text("\n".join([record(1, "red dev"), record(2, "blue"), record(2, "red again"), record(3, None), "{broken", record(4, "red", salary_min=-1)]))
    posts = spark.createDataFrame([(1, "en", "red blue", "")], "id long, language string, title string, description string")
    words = spark.createDataFrame([("red",), ("blue",)], "term string")
    known = ingest.Dictionaries(enrich.language_profile(posts), words, dims.keywords(spark), dims.negatives(spark), dims.categories(spark))

    def run():
        return ingest.ingest(spark, f"file://{landing}", star, f"file://{tmp_path}/checkpoint", "feed", "xx", AS_OF, known)

    one = {"extracted": 6, "transformed": 4, "enriched": 4, "validated": 3, "failed": 3, "inserted": 2, "updated": 1, "purged": 0, "skills": 1, "relationships": 2}
    assert run() == [one]
    (landing / "b.txt").write_text(record(2, "blue at last"))
    assert run() == [one | {"extracted": 1, "transformed": 1, "enriched": 1, "validated": 1, "failed": 0, "inserted": 0, "updated": 1, "relationships": 1}] and run() == []
    rows = {r.source_id: (r.title, r.is_active) for r in snapshots.latest(spark, f"{star}/jobs", "source_id string, title string, is_active boolean").collect()}
    assert rows == {"1": ("red dev", True), "2": ("blue at last", True)}
    raw = spark.createDataFrame([(record(1, "changed"), "xx")], "raw string, _source_country string")
    assert ingest.load_batch(raw, star, "feed", AS_OF, known, batch=1) == {} and len(snapshots.versions(spark, f"{star}/jobs")) == 2
    assert ingest.load_batch(raw, star, "feed", AS_OF, known)["updated"] == 1
