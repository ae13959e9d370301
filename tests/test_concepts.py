"""Concepts: answers that aren't as asked for, corrections, merges in chains, the graph's limits."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quirewell.operators import concepts as C

NOTES = [("a", "n1", "b1", "x" * 200), ("a", "n2", "b2", "short")]


def judged(spark, *texts):
    answers = C.parse_answers(spark.createDataFrame([("a", t) for t in texts], "answer_id string, text string"))
    notes = spark.createDataFrame(NOTES, "answer_id string, note_id string, book_id string, content string")
    e = C.judge_entities(answers, notes)
    return e, C.judge_relations(answers, e, notes, spark.createDataFrame([("Old",)], "name string"))


ANSWER = """Of course: ```json
{"entities": [
 {"kind": " TOPIC ", "name": "One   thing", "confidence": 3, "aliases": ["One thing", " al ", "al", 5, ""], "evidence_note_ids": ["n1", " n2 ", "", "made up"]},
 {"kind": "topic", "canonical_name": "One thing", "evidence_note_ids": ["n1"]},
 {"kind": "idea", "canonical_name": "Two", "evidence_note_ids": ["made up"]},
 {"kind": "place", "canonical_name": "Three", "evidence_note_ids": ["n1"]},
 {"kind": "idea", "canonical_name": "  "}, {"kind": "idea"}, 7],
 "relations": [
 {"from": "One thing", "to": "Two", "relation": "Related", "evidence_note_ids": ["n2"]},
 {"from": "One thing", "to": "Three", "relation": "related", "evidence_note_ids": ["n2"]},
 {"from": "Old", "to": "Two", "relation": "causes", "confidence": "sure", "evidence_note_ids": ["n9"]},
 {"from": "Old", "to": "Old", "relation": "causes"}, {"from": "Old", "to": "Two", "relation": "eats"}, {"to": "Two", "relation": "causes"}]}
``` {done"""


def test_answers(spark):
    e, r = judged(spark, ANSWER)
    got = {x["at"]: x for x in e.collect()}
    assert [got[i]["verdict"] for i in range(7)] == ["accepted", "repeated", "without_evidence", "bad_kind", "blank_name", "blank_name", "blank_name"]
    one = got[0]
    assert (one["name"], one["kind"], one["aliases"], one["unknown"]) == ("One thing", "topic", ["al", "5"], 1)
    assert [(x["note_id"], x["book_id"], len(x["quote"]), x["confidence"]) for x in one["evidence"]] == [("n1", "b1", 160, 1.0), ("n2", "b2", 5, 1.0)]
    assert [x["verdict"] for x in sorted(r.collect(), key=lambda x: x["at"])] == ["accepted", "unknown_endpoint", "unknown_note", "self", "bad_kind", "blank_name"]
    assert [tuple(x) for x in C.rejected(e, r).collect()] == [("a", 1, 3, 1, 2)]
    seen = Observation()
    assert C.accepted(e, seen).count() == 1 and seen.get["without_evidence"] == 1 and seen.get["repeated"] == 1


@pytest.mark.parametrize("text", [None, "", "no json", "{", "}{", "{broken}", '{"entities": 5}', '{"entities": [], "relations": {"a": 1}}'])
def test_unreadable(spark, text):
    e, r = judged(spark, text)
    assert e.count() == r.count() == 0


ENTITY = "id string, kind string, name string, description string, aliases array<string>, status string"
EVIDENCE = "entity_id string, note_id string, book_id string, quote string, confidence double"
RELATION = "id string, a string, b string, relation string, summary string, confidence double"


def tables(spark):
    e = [("a", "idea", "A", "", ["x"], "confirmed"), ("b", "idea", "B", "of b", ["A", "y"], "suggested"), ("c", "idea", "C", "of c", None, "hidden"), ("d", "topic", "D", "", [], "suggested")]
    v = [("a", "n1", "k1", "qa", 0.4), ("b", "n1", "k2", "qb", 0.3), ("c", "n1", "k3", "qc", 0.9), ("c", "n2", "k3", "q2", 0.1)]
    r = [("r1", "a", "b", "related", "", 0.5), ("r2", "b", "d", "related", "", 0.6), ("r3", "d", "c", "related", "", 0.7), ("r4", "d", "c", "causes", "", 0.2)]
    return spark.createDataFrame(e, ENTITY), spark.createDataFrame(v, EVIDENCE), spark.createDataFrame(r, RELATION)


def test_merge(spark):
    asked = spark.createDataFrame([("c", "b"), ("b", "a")], "source string, target string")
    e, v, r = C.merge(*tables(spark), asked)
    assert sorted(map(tuple, e.select("id", "description", "aliases").collect())) == [("a", "of c", ["x", "B", "y", "C"]), ("d", "", [])]
    assert sorted(map(tuple, v.collect())) == [("a", "n1", "k1", "qc", 0.9), ("a", "n2", "k3", "q2", 0.1)]
    assert sorted(map(tuple, r.select("id", "a", "b").collect())) == [("r2", "a", "d"), ("r4", "d", "a")]


def test_merge_targets(spark):
    make = lambda rows: spark.createDataFrame(rows, "source string, target string")
    chain = [(f"x{i}", f"x{i + 1}") for i in range(21)]
    assert {tuple(x) for x in C.merge_targets(make(chain)).collect()} == {(f"x{i}", "x21") for i in range(21)}
    assert C.merge_targets(make([("a", "a")])).count() == 0
    for bad in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "a")]):
        with pytest.raises(ValueError):
            C.merge_targets(make(bad))


def test_correct(spark):
    e, _, _ = tables(spark)
    edit = lambda *x: spark.createDataFrame([x], "id string, name string, description string, status string, aliases array<string>")
    got = {x["id"]: x for x in C.correct(e, edit("c", " New  name ", None, "confirmed", ["k", "New name", "k"])).collect()}
    assert (got["c"]["name"], got["c"]["description"], got["c"]["status"], got["c"]["aliases"]) == ("New name", "of c", "confirmed", ["k"])
    assert got["a"]["aliases"] == ["x"]
    for bad in (("c", " ", None, None, None), ("c", None, None, "gone", None), ("z", "n", None, None, None)):
        with pytest.raises(ValueError):
            C.correct(e, edit(*bad))


def test_clear(spark):
    e, v, r = C.clear_suggested(*tables(spark))
    ids = lambda d, c: sorted(x[c] for x in d.collect())
    assert (ids(e, "id"), ids(v, "entity_id"), ids(r, "id")) == (["a", "c"], ["a", "c", "c"], [])


def test_graph(spark):
    e, v, r = tables(spark)
    e = e.withColumn("updated_at", F.lit(1))
    ids = lambda d: sorted(x["id"] for x in d.collect())
    nodes, links = C.concept_graph(e, v, r)
    assert ids(nodes) == ["a", "b"] and ids(links) == ["r1"] and nodes.first()["total"] == 3
    nodes, links = C.concept_graph(e, v, r, many=2)  # too many: only sure ones, of which none is visible
    assert nodes.count() == 0 and C.concept_graph(e, v, r, many=2, hidden=True)[0].first()["truncated"]
    nodes, links = C.concept_graph(e, v, r, centre="d")
    assert ids(nodes) == ["b", "d"] and ids(links) == ["r2"] and nodes.first()["total"] == 3
    assert ids(C.concept_graph(e, v, r, centre="d", hidden=True)[1]) == ["r2", "r3", "r4"]
    with pytest.raises(ValueError):
        C.concept_graph(e, v, r, ["animal"])


def test_persist_again(spark):
    """An extraction that is stored twice changes nothing the second time."""
    e, r = judged(spark, ANSWER)
    notes = spark.createDataFrame([("n1", "c")], "note_id string, content string")
    none = [spark.createDataFrame([], s) for s in (ENTITY, EVIDENCE, RELATION, "note_id string, content_hash string")]
    once = C.persist(*none, C.accepted(e), C.accepted(r), notes)
    twice = C.persist(*once, C.accepted(e), C.accepted(r), notes)
    for x, y in zip(once, twice, strict=True):
        assert sorted(map(repr, x.collect())) == sorted(map(repr, y.collect())) and x.count() > 0 or x is once[2]
    assert C.unchanged(notes, once[3]).count() == 1
