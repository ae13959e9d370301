"""What the findings of round 3 named."""

import json
import os
import re

from pyspark.sql import functions as F

from quirewell.operators import concepts as C
from quirewell.operators import graph as G
from quirewell.operators import ingest as I
from quirewell.operators import retrieval as R
from quirewell.operators import search_index
from quirewell.sources import documents as D
from quirewell.sources.cursor import LandedPages


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_postings_are_not_broadcast(spark):
    """files of few distinct values look small; their postings filled the driver."""
    p = spark.range(0, 400).select(F.col("id").alias("node"), (F.col("id") % 40).alias("k"))
    pairs = G.posting_pairs(p, "k", "node", 2, 10)
    joins = plan(pairs)
    assert joins.count("SortMergeJoin") == 1 and joins.count("BroadcastHashJoin") == 2  # postings with postings; the keys with either side
    assert pairs.count() == 40 * 45 and G.posting_pairs(p, "k", "node", 2, 9).count() == 0


def test_a_hot_key_is_many_tasks_work(spark, monkeypatch):
    """a key's pairs were made by the task that had the key."""
    monkeypatch.setattr(G, "KEY_BLOCK", 50)
    monkeypatch.setattr(G, "TASK_PAIRS", 500)
    rows = [(i, "hot" if i % 10 else None if i % 20 else f"rare {i // 40}", ("x", "y", "z", None)[i % 4]) for i in range(300)]
    t = spark.createDataFrame(rows, "n long, k string, v string")
    got = G.conflicts(t, "k", "n", "v")
    want = {(a, b) for a, k, v in rows for b, m, w in rows if a < b and k is not None and k == m and v and w and v != w}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    met = G.conflicts(t, "k", "n", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(met) >= 8 and max(r["count"] for r in met) < len(want) / 4


def test_more_pages_than_one_batch_had(spark, tmp_path):
    """a stream run to its end took 100 pages of a chain and left the rest out."""
    spark.dataSource.register(LandedPages)
    land = lambda p, more: (os.makedirs(f"{tmp_path}/in/chain=c/cursor={p or 'first'}"), open(f"{tmp_path}/in/chain=c/cursor={p or 'first'}/p.json", "w").write(json.dumps({"items": [{"id": p}], "has_more": more, "next": p + 1})))  # noqa: E731, SIM115
    for p in range(230):
        land(p, 1)

    def run():
        stream = spark.readStream.format("landed_pages").option("path", f"{tmp_path}/in").load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return sorted(json.loads(r["item"])["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(230))
    for p in range(230, 360):
        land(p, int(p < 359))
    assert run() == list(range(360))
    assert spark.read.format("landed_pages").option("path", f"{tmp_path}/in").load().count() == 360


def test_an_index_is_written_by_more_tasks_as_it_grows(spark, monkeypatch, tmp_path):
    """A bucket was sorted by one task, and words were dealt out, counted and joined by id."""
    monkeypatch.setattr(search_index, "BLOCK", 10)
    monkeypatch.setattr(search_index, "TOGETHER", 4)
    rows = spark.range(400).select(F.col("id"), F.concat_ws(" ", F.lit("the w"), F.col("id") % 7, F.repeat(F.lit("pad "), (F.col("id") % 5).cast("int"))).alias("text"))
    index = search_index.SearchIndex.build(rows, f"file://{tmp_path}/i", "id", ("text",), buckets=2)
    files = [f for b in os.listdir(f"{tmp_path}/i/gen=0/postings") if b.startswith("bucket=") for f in os.listdir(f"{tmp_path}/i/gen=0/postings/{b}") if f.endswith(".parquet")]
    assert len(files) >= 8
    sizes = index._read(index.manifest()[0], "postings").agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    assert sizes["n"] <= 30 and sizes["all"] == index.entries().count() == 400 * 3 + 320  # a block has less than three times BLOCK
    index.update(rows.limit(0), rows.select("id").where("id < 100"), "id", ("text",))
    index.compact()
    assert index.entries(["the"]).count() == index.docs().count() == 300 and index.match(["pad"], 1000).count() == 240


def test_words_are_counted_by_tasks_of_one_size(spark, monkeypatch):
    """the number of tasks did not follow the texts."""
    monkeypatch.setattr(R, "TASK_CHARS", 100)
    rows = spark.range(200).select(F.col("id"), F.concat_ws(" ", F.lit("the the w"), F.col("id")).alias("text"), F.lit(None).cast("string").alias("more"))
    got = R.postings(rows, "id", "text", "more")
    assert got.rdd.getNumPartitions() >= 20
    assert sorted((r["id"], r["term"], r["tf"]) for r in got.collect() if r["term"] == "the") == [(i, "the", 2) for i in range(200)] and got.count() == 600
    twice = rows.union(rows)
    assert R.postings(twice, "id", "text").where("term = 'the' AND tf = 4").count() == 200
    assert R.postings(rows.limit(0), "id", "text").count() == 0


def test_answers_are_parsed_once(spark):
    """Entities and relations each made and parsed the answers' JSON anew, several times over."""
    told = '{"entities": [{"kind": "idea", "name": "Ö}"}], "relations": [{"from": "a"}]}'
    texts = [f"é ```{told}``` ü {{", told, f"}} {told} no more", "}{", "é{", "ü}", None]
    parsed = C.parse_answers(spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string"))
    assert not re.search("parse_?json", parsed._jdf.queryExecution().optimizedPlan().toString(), re.I)
    got = parsed.selectExpr("answer_id", "size(entities)", "size(relations)", "readable", "try_variant_get(get(entities, 0), '$.name', 'string')").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: (1, 1, True, "Ö}") if i < 3 else (0, 0, False, None) for i in range(7)}


def test_each_file_of_a_dump_is_a_task(spark, tmp_path):
    """paths are small, so the partitions that held them were put together and one task read all files."""
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id><revision><id>1</id><text bytes='/'>{0}</text></revision></page>"
    for i in range(12):
        (tmp_path / f"{i}.xml").write_text(page.format(i))
    got = D.read_guarded_dump(spark, str(tmp_path)).select("page_id", "text", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, str(i)) for i in range(12)] and len({r["task"] for r in got}) >= 8


def test_end_of_a_long_page_in_two_chunks():
    """where a page was found to be too long with its end half read, the page after it was lost."""
    page = "<page><title>a</title><ns>0</ns><id>{}</id><revision><id>2</id><text>{}</text></revision></page>"
    data = (page.format(1, "z" * 70_000) + page.format(2, "two")).encode()
    for cut in range(70_000, 70_100):
        assert [(p["page_id"], p["issue"], p["text"]) for p in D.dump_pages(iter([data[:cut], data[cut:]]), 2000) if p] == [(1, "oversized", None), (2, None, "two")]


def test_pages_are_not_broadcast(spark, monkeypatch):
    """each step of a walk broadcast all redirects, so a task held a dozen tables of all pages."""
    monkeypatch.setattr(I, "TASK_PAGES", 50, raising=False)
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("T"), F.col("id") % 500).alias("title"), F.when(F.col("id") >= 100, F.col("id") % 100).alias("target"))
    found = I.aliases(pages, I.resolve_redirects(pages))
    assert "Broadcast" not in plan(found)
    assert {r["page_id"]: r["aliases"] for r in found.collect()} == {i: [f"T{i + j}" for j in (100, 200, 300, 400)] for i in range(100)}
    tasks = I.resolve_redirects(pages).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 8


def test_pages_come_in_batches_of_bounded_bytes(spark):
    """batches held up to 10000 rows or 64 MB, so a worker's memory grew with the pages up to these."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    html = F.when(F.col("id") % 7 != 0, F.concat(F.lit("<title>T</title><p>a &amp; "), F.col("id"), F.lit("<nav>no</nav></p>"), F.repeat(F.lit("<p>word</p>"), 300)))
    pages = spark.range(0, 1500, 1, 1).select(F.col("id").alias("page_id"), html.alias("html"))
    got = {r["page_id"]: (r["title"], r["text"]) for r in D.html_documents(pages).collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(512 << 10)
    assert got == {r["page_id"]: ("T" if r["html"] else None, D.html_text(r["html"])) for r in pages.collect()}
    assert got[1][1].startswith("a & 1\n\nword") and got[0] == (None, "")
