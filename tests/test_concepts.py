"""Answers of models, concepts, prerequisites in two passes, and providers."""

import urllib.error

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.functions import answers, provider
from folium.operators import concepts, prereqs
from folium.operators.storage import written


def test_answers():
    assert answers.parse('pre {"a":{"b":1}} post') == {"a": {"b": 1}}
    assert answers.parse("{'a':1}") == {} and answers.parse("no json") == {} and answers.parse("[1]") == [1] and answers.parse('a } b { c') == {} and answers.parse("") == {}
    assert answers.as_strings([1, None, True, " a ", ""]) == ["1", "None", "True", "a"]
    assert answers.as_strings(None) == [] and answers.as_strings("x") == ["x"]
    assert answers.distinct([" Observer ", "observer", "", "Encapsulation", None]) == ["Observer", "Encapsulation"]
    assert answers.prerequisites_of({"noisy": "false", "prerequisites": ["OBSERVER", "Events", "events"]}, "Observer") == (True, ["Events"])
    assert answers.as_object({"message": {"content": '{"concepts": ["a"]}'}}) == {"concepts": ["a"]}
    assert answers.as_object({"response": '{"noisy": true}'}) == {"noisy": True} and answers.as_object([1]) == {} and answers.as_object("[1]") == {}


def found(spark):
    return spark.createDataFrame([(1, "b", "02", 0, 0, "Observer"), (1, "b", "02", 0, 1, "State"), (2, "b", "01", 0, 0, "observer")], "id long, book_title string, chapter string, section_index int, pos int, concept string")


def test_index(spark):
    f = found(spark)
    assert {tuple(r) for r in concepts.counts(f).collect()} == {("observer", 2), ("state", 1)}
    assert {r.concept for r in concepts.surface_forms(f).collect()} == {"Observer", "State"}
    index = concepts.index(f)
    assert {(r.canon, r.chapter, r.occurrences) for r in index.collect()} == {("observer", "01", 2), ("State", "02", 1)}
    places = {(r.canon, r.chapter) for r in concepts.occurrences(f, index).collect()}
    assert places == {("observer", "01"), ("observer", "02"), ("State", "02")}
    only = spark.createDataFrame([("state",)], "lower string")
    assert concepts.index(f, only).count() == 1 and concepts.index(f, only.limit(0)).count() == 2


class Scripted:
    """Fails for some, and says that concepts are noisy unless there is a context."""

    def generate(self, system, user, params=None):
        if "broken" in user:
            raise provider.Failed("no answer")
        if system == provider.FIND_CONCEPTS:
            return {"concepts": user.split()[:2]}
        return {"noisy": "CONTEXT" not in user, "prerequisites": ["p", user[9:]]}


def test_extract_counts_errors(spark):
    text = lambda head: head + " x" * 60
    df = spark.createDataFrame([(1, "b", "1", 0, text("one two")), (2, "b", "1", 1, text("broken")), (3, "b", "1", 2, "short"), (4, "b", "1", 3, None)], "id long, book_title string, chapter string, section_index int, content string")
    got, metrics = concepts.extract(df, Scripted)
    assert [(r.id, r.pos, r.concept) for r in got.orderBy("pos").collect()] == [(1, 0, "one"), (1, 1, "two")]
    assert tuple(metrics.first()) == (2, 1)


def test_two_passes(spark):
    s = spark.createDataFrame([("b", "1", 0, "some text"), ("b", "2", 0, " \n")], "book_title string, chapter string, section_index int, content string")
    canon = spark.createDataFrame([("often", "Often", "b", "1", 0), ("once", "Once", "b", "1", 0), ("blank", "Blank", "b", "2", 0), ("broken", "broken", "b", "1", 0)], "lower string, canon string, book_title string, chapter string, section_index int")
    counts = spark.createDataFrame([("often", 2), ("once", 1), ("broken", 1)], "lower string, count long")
    records, errors = prereqs.assess(canon, counts, s, Scripted)
    got = {r.concept: (r.noisy, r.prerequisites, r.rechecked) for r in records.collect()}
    assert got["Often"] == (False, ["p"], False) and got["Once"][0] is False and got["Once"][2] is True
    assert got["Blank"] == (True, ["p"], False) and got["broken"] == (False, [], False)
    assert errors.first().asDict() == {"concepts": 4, "errors": 1, "noisy": 1, "rechecked": 1}
    names = spark.createDataFrame([("Often",), ("OFTEN",), ("none",)], "concept string")
    assert sorted((r.concept, r["count"]) for r in concepts.frequency(names, counts).collect()) == [("OFTEN", 2), ("Often", 2), ("none", 0)]


def test_http_retries():
    calls, naps = [], []

    def send(url, body, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return {"message": {"content": '{"concepts": ["a"]}'}}

    h = provider.Http("http://h/", "m", send=send, sleep=naps.append)
    assert h.generate("s", "u") == {"concepts": ["a"]} and len(calls) == 3
    assert any(1.5 <= n <= 2.0 for n in naps) and any(2.55 <= n <= 3.05 for n in naps)

    def refuse(url, body, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(provider.Failed):
        provider.Http("h", "m", send=refuse, sleep=naps.append).generate("s", "u")
    broken = provider.Http("h", "m", send=lambda *a: (_ for _ in ()).throw(ValueError()), sleep=naps.append)
    assert broken.generate("s", "u") == {} and broken.models() == [] and broken.ping() is False
    assert provider.Params(stop=("x",), seed=1, other=2, top_p=None).options == {"temperature": 0.0, "num_predict": 400, "stop": ["x", "<think>", "</think>"], "seed": 1}
    assert provider.Params(thinking=True, temperature=0.5).options == {"temperature": 0.5, "num_predict": 400, "stop": []}
    h.set_model("other")
    sent = h.payload("s", "u", provider.Params(stream=True))
    assert (sent["model"], sent["format"], sent["stream"], sent["keep_alive"], sent["options"]["num_predict"]) == ("other", "json", True, "10m", 400)


def test_written_tables_take_small_batches(spark):
    """A worker's memory must not follow the texts' length times 10,000 rows."""
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    got = [r.n for r in written(rows.mapInArrow(sizes, "n long"), "batches").collect()]
    assert sum(got) >= 16_000_000 and max(got) < 6_000_000 and spark.conf.get(limit, None) == before
