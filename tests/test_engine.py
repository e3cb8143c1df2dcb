"""Inference, layout, shredding and the workload on small corpora."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from docweave import corpora
from docweave.config import Config
from docweave.errors import Refused
from docweave.functions.select import facts, select
from docweave.lattice import TAGS, at_most, join
from docweave.operators.contract import duplicate_keys, enforced, null_counts, verified
from docweave.operators.observe import merged, observed
from docweave.operators.reassemble import nested
from docweave.operators.shred import shredded
from docweave.paths import order, parsed, shown
from docweave.plans.infer import infer, infer_parts, settled
from docweave.plans.layout import laid_out, mangled
from docweave.plans.stores import break_even, disagreements
from docweave.queries import flat, queries, raw, records
from docweave.oracle import oracle_sql
from docweave.sources import corpus
from docweave.streaming.incremental import Incremental

from duck import same

ORDERS = [
    {"number": 1, "customer": {"name": "a", "email": "e"}, "items": [{"sku": "x", "qty": 1, "price": 9.99}, {"sku": "y", "qty": 2, "price": 24.5}], "tags": ["p", "q"], "labels": {"priority": "hi", "channel": "web"}, "note": None},
    {"number": 2, "customer": {"name": "b"}, "items": [{"sku": "z", "qty": 5, "price": 3}], "tags": [], "labels": {"priority": "lo"}},
]


def schema(spark, docs, config=None):
    return infer(corpus.text(spark, docs if isinstance(docs, str) else json.dumps(docs)), config)


def columns(i, path):
    return {c.name: (c.type, c.nullable) for c in i.tables[parsed(path)]}


def test_lattice_is_one():
    for a, b, c in itertools.product(TAGS, repeat=3):
        assert join(a, b) == join(b, a) and join(a, a) == a
        left, right = join(a, b) and join(join(a, b), c), join(b, c) and join(a, join(b, c))
        assert left == right
        if join(a, b):
            assert at_most(a, join(a, b)) and at_most(b, join(a, b))


def test_paths():
    assert parsed(".runs[].jobs[]") == (".runs", "[]", ".jobs", "[]") and parsed(".") == ()
    assert shown((".a", "{}")) == ".a{}"
    assert sorted([(".b",), (".a", "{}"), (".a", "[]"), (".a",), (".a", ".c")], key=order) == [(".a",), (".a", ".c"), (".a", "[]"), (".a", "{}"), (".b",)]


def test_mangling_keeps_names_apart():
    names = ["private", "a_b", "a-b", "A", "f_61", "5f61", "é", "_", "'", "end", "end_"]
    assert len({mangled(n) for n in names}) == len(names)
    assert mangled("private") == "private_" and mangled("job_id") == "job_5fid"


def test_orders(spark):
    i = schema(spark, ORDERS, {"maps": [".labels"]})
    assert columns(i, ".") == {"customer": ("ref", False), "items": ("coll", False), "labels": ("coll", False), "note": ("bot", True), "number": ("int", False), "tags": ("coll", False)}
    assert columns(i, ".items[]")["price"] == ("float", False) and i.visits[parsed(".items[]")] == 3
    note = next(c for c in i.tables[()] if c.name == "note")
    assert (note.values, note.nulls, note.absent, note.never_typed) == (0, 1, 1, True)
    layout = laid_out(i)
    assert [f.name for f in layout.by_name()["labels"].fields] == ["id", "root_id", "key", "value"]
    tables = shredded(corpus.text(spark, json.dumps(ORDERS)), layout)
    verified(tables, layout)
    assert sorted(tuple(r) for r in tables["labels"].select("key", "value").collect()) == [("channel", "web"), ("priority", "hi"), ("priority", "lo")]
    assert "not null" in layout.ddl() and "foreign key" in layout.constraints() and "root" in layout.described()
    back = {r["number"]: r for r in nested(tables, layout).collect()}
    assert [x["sku"] for x in back[1]["items"]] == ["x", "y"] and back[1]["tags"] == ["p", "q"] and back[2]["tags"] == []
    assert back[1]["labels"] == {"priority": "hi", "channel": "web"} and back[2]["customer"]["email"] is None


def test_a_lone_object_is_an_array_of_one(spark):
    docs = [{"id": 1, "tags": {"name": "a", "colour": "r"}}, {"id": 2, "tags": [{"name": "b", "colour": "g"}, {"name": "c", "colour": "b"}]}, {"id": 3, "tags": [{"name": "d", "colour": "w"}]}]
    i = schema(spark, docs)
    assert columns(i, ".tags[]") == {"colour": ("str", False), "name": ("str", False)} and i.visits[parsed(".tags[]")] == 4
    layout = laid_out(i)
    rows = shredded(corpus.text(spark, json.dumps(docs)), layout)["tags"].select("root_id", "idx", "name").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (3, 0, "d")]


def test_collapse_reaches_inner_members(spark):
    docs = [{"b": {"x": {"n": 1}}}, {"b": [{"x": [{"n": 2}]}, {"x": {"n": 3}}]}]
    i = schema(spark, docs)
    assert set(map(shown, i.tables)) == {".", ".b[]", ".b[].x[]"} and i.visits[parsed(".b[].x[]")] == 3
    rows = shredded(corpus.text(spark, json.dumps(docs)), laid_out(i))["b_x"].collect()
    assert sorted(r["n"] for r in rows) == [1, 2, 3]


def test_scalars(spark):
    u = "0B2B4C6D-0000-0000-0000-00000000000f"
    docs = '[{"a":4611686018427387903,"b":1,"c":1.0,"d":"%s","e":"%s","f":true},{"a":1,"b":4611686018427387904,"c":1e3,"d":"%s","e":"x","f":null}]' % (u, u, u)
    i = infer(corpus.text(spark, docs))
    assert columns(i, ".") == {"a": ("int", False), "b": ("float", False), "c": ("float", False), "d": ("uuid", False), "e": ("str", False), "f": ("bool", True)}
    b = next(c for c in i.tables[()] if c.name == "b")
    assert b.big and b.widened


@pytest.mark.parametrize(("text", "config", "code"), [
    ('[{"a":1},{"a":"x"}]', None, "typeConflict"), ('[{"t":{"n":1}},{"t":[]}]', None, "typeConflict"), ('{"a":[[1]]}', None, "nestedArray"), ('{"a":[{"n":1}, 2]}', None, "mixedElements"),
    ('{"a":1}', {"maps": [".nope"]}, "markingMatchedNothing"), ('{"m":{"k":[1]}}', {"maps": [".m"]}, "mapEntryNotSupported"), ('[{"id":1},{"a":1}]', None, "unusableKey"), ('{"id":{"a":1}}', None, "unusableKey"),
    ('{"id":null}', None, "unusableKey"), ('{"xs":[{"idx":1}]}', None, "reservedColumnName"), ('{"a":[{"n":1}],"b":[{"n":1}]}', {"names": {".a": "x", ".b": "x"}}, "tableNameClash"), ('{"xs":[{"IDX":1}]}', None, "reservedColumnName"),
])
def test_refusals(spark, text, config, code):
    with pytest.raises(Refused) as e:
        laid_out(infer(corpus.text(spark, text), config))
    assert e.value.code == code


@pytest.mark.parametrize(("text", "code"), [("3", "notObjectOrArray"), ('[{"a":1}, 2]', "arrayElementNotObject"), ('{"a":1,"a":2}', "duplicateMember"), ('{"a":1} x', "invalidJson"), ('{"a":1} {"a":2}', "invalidJson"), ('{"a":1,}', "invalidJson")])
def test_texts_that_are_no_corpus(spark, text, code):
    with pytest.raises(Exception) as e:  # noqa: PT011
        infer(corpus.text(spark, text))
    assert corpus.refusal(e.value).code == code


@pytest.mark.parametrize("given", [{"recursive": [".a"]}, {"other": 1}, {"root": ""}, {"maps": ["a"]}, {"names": {".a": ""}}])
def test_configurations(given):
    with pytest.raises(Refused):
        Config.of(given)


def made(rng, depth=0):
    out = {"n": rng.choice([1, 2.5, None]), "s": rng.choice(["a", "b"])}
    if rng.random() < 0.5:
        out["t"] = rng.choice([None, "x"])
    if depth < 2 and rng.random() < 0.7:
        out["kids"] = [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if depth < 2 and rng.random() < 0.4:
        out["one"] = made(rng, depth + 1)
    if rng.random() < 0.4:
        out["nums"] = [rng.randint(0, 9) for _ in range(rng.randint(0, 3))]
    return out


def plain(doc, like):
    """A document without what is null or empty, numbers as floats: what a round trip keeps."""
    if isinstance(doc, dict):
        return {k: v for k, x in doc.items() if k != "id" and (v := plain(x, like)) not in (None, [], {})}
    if isinstance(doc, list):
        return [plain(x, like) for x in doc]
    return float(doc) if isinstance(doc, (int, float)) and not isinstance(doc, bool) else doc


def test_rows_survive(spark):
    rng = random.Random(4)
    docs = [made(rng) | {"at": i} for i in range(12)]
    c = corpus.text(spark, json.dumps(docs))
    i = infer(c)
    layout = laid_out(i)
    tables = {n: df.cache() for n, df in shredded(c, layout).items()}
    verified(tables, layout)
    back = {int(r["at"]): r.asDict(recursive=True) for r in nested(tables, layout).collect()}
    assert {k: plain(v, None) for k, v in back.items()} == {d["at"]: plain(d, None) for d in docs}
    for columns_ in i.tables.values():
        assert all(x.nullable == (x.nulls + x.absent > 0) for x in columns_)


def test_the_middle_is_found_without_sorting_half(spark, monkeypatch):
    from docweave.plans import report

    monkeypatch.setattr(report, "TOGETHER", 50, raising=False)
    monkeypatch.setattr(report, "GUESSES", 64, raising=False)
    skipped, offset = [], type(spark.range(1)).offset
    monkeypatch.setattr(type(spark.range(1)), "offset", lambda df, n: skipped.append(n) or offset(df, n))
    rng = random.Random(5)
    for type_, values in (("long", [rng.randrange(-10**12, 10**12) for _ in range(1501)]), ("string", [f"{rng.random()}é" for _ in range(1000)]), ("long", [7] * 900 + list(range(500))), ("double", [0.5] * 40 + [float("nan")] * 999), ("long", [None] * 600 + list(range(700))), ("long", [None, None, 3]), ("long", [])):
        got = report.middle_id(spark.createDataFrame([(v,) for v in values], f"id {type_}"))
        by = sorted(values, key=lambda v: (v is not None, v is not None and v != v, 0 if v is None or v != v else v))
        assert repr(got) == repr(by[len(by) // 2] if by else None)
    assert max(skipped) <= 50


def test_reassembly_moves_only_what_is_read(spark, folder):
    plan = queries()["reassemble_totals"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(grouped) == 3 and not any(n in line for line in grouped for n in ("bp", "status", "name", "line#"))
    docs = [made(random.Random(n)) | {"at": n} for n in range(12)]
    c = corpus.text(spark, json.dumps(docs))
    layout = laid_out(infer(c))
    tables = shredded(c, layout)
    every = nested(tables, layout, {t.name: [f.name for f in t.fields] for t in layout.tables.values()}).collect()
    assert sorted(map(repr, every)) == sorted(map(repr, nested(tables, layout).collect()))


def test_order_and_parts_do_not_matter(spark):
    rng = random.Random(9)
    docs = [made(rng) for _ in range(10)]
    whole = schema(spark, docs).tables
    rng.shuffle(docs)
    assert schema(spark, docs).tables == whole
    parts = [observed(corpus.text(spark, json.dumps(docs[k::3]))) for k in (2, 0, 1)]
    assert infer_parts(parts).tables == whole == settled(merged(merged(parts[2], parts[0]), parts[1])).tables


def test_empty_corpus(spark):
    i = schema(spark, [])
    assert i.tables == {(): ()} and shredded(corpus.text(spark, "[]"), laid_out(i))["root"].count() == 0


def test_null_in_a_total_column_raises(spark):
    layout = laid_out(schema(spark, [{"id": 1, "q": 5}, {"id": 2, "q": 6}]))
    t = layout.by_name()["root"]
    bad = spark.createDataFrame([(1, 5), (2, None), (2, 3)], "id long, q long")
    good = enforced(bad.where("q is not null"), t)
    assert not good.schema["q"].nullable and null_counts(bad, t) == {"id": 0, "q": 1} and duplicate_keys(bad).count() == 1
    with pytest.raises(Exception, match="NULL in the data"):
        enforced(bad, t).collect()
    with pytest.raises(Refused):
        verified({"root": bad}, layout)


def test_ndjson_and_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a":1}\n\n{"a":2}\n{"a":2}\n')
    (tmp_path / "b.json").write_text('[{"a":1},{"a":2}]')
    lines = corpus.ndjson(spark, str(tmp_path / "a.ndjson"))
    assert infer(lines).visits[()] == 3 and lines.select("doc_ord").distinct().count() == 3
    assert infer(corpus.json_file(spark, str(tmp_path / "b.json"))).visits[()] == 2


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    docs = corpora.events(spark, "/root/testdata/sf0.001").where("doc_ord < 30")
    for k in range(3):
        docs.where(F.pmod("doc_ord", F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(source))
    growing = Incremental(spark, str(tmp_path / "said"), corpora.EVENTS_CONFIG)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    growing.over(stream, str(tmp_path / "check")).awaitTermination()
    more = corpora.events(spark, "/root/testdata/sf0.001").where("doc_ord between 30 and 40")
    more.coalesce(1).write.mode("append").parquet(str(source))
    docs = docs.unionByName(more)
    growing = Incremental(spark, str(tmp_path / "said"), corpora.EVENTS_CONFIG)  # as after a restart
    growing.over(stream, str(tmp_path / "check")).awaitTermination()
    assert growing.inference().tables == infer(corpus.from_rows(docs), corpora.EVENTS_CONFIG).tables


def test_lines_are_numbered_apart(spark, tmp_path):
    lines = ['{"a":1}'] * 50 + ['{"a":2}', '{"a":3}', '{"a":2}', "", "  "]
    for k in range(3):
        (tmp_path / f"{k}.ndjson").write_text("\n".join(lines[k::3]))
    read = lambda: sorted((r["doc_ord"], r["d"]) for r in corpus.ndjson(spark, str(tmp_path)).select("doc_ord", F.to_json("doc").alias("d")).collect())
    got = read()
    assert len(got) == len({d for d, _ in got}) == 53 and got == read()


def test_reading_refuses_what_follows_a_value(spark):
    texts = ['{"a":1}', '{"a":1}] x', '{"a":1}], [{"b":2}', '{"a":1},0] x', '{"a":1} {"b":2}', ' {"a":"] x"}\n', None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_ord long, value string")
    got = {r["doc_ord"] for r in df.select("doc_ord", corpus.strict(F.col("value")).isNotNull().alias("ok")).where("ok").collect()}
    assert got == {0, 5} and {r["doc_ord"]: r["code"] for r in corpus.refusals(df).collect()} == dict.fromkeys((1, 2, 3, 4, 6, 7), "invalidJson")


def test_stores_agree(spark, folder):
    stores = {"raw": raw(spark, folder), "nested": records(spark, folder), "flat": flat(spark, folder)}
    asked = {"document": lambda s: s.document(3), "unknown": lambda s: s.document(-5), "scan": lambda s: s.scan(1000), "computed": lambda s: s.computed(0), "by_name": lambda s: s.by_name(), "three_hop": lambda s: s.three_hop("MACHINERY"), "none": lambda s: s.three_hop("?")}
    assert disagreements(stores, asked) == []


def test_break_even():
    assert break_even(1, 2, 1.0, 1.2) == "neither" and break_even(1, 3, 2.0, 1.0) == "b after 2 queries" and break_even(3, 1, 2.0, 1.0) == "b is faster"


def test_select_and_facts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "it's", 3)], "id long, s string, q long")
    assert [r["id"] for r in select("select id from t where s = 'it''s'", {"t": df}).collect()] == [2]
    assert select("select id from t where q < 5", {"t": df}).count() == 1
    found = facts(df.select("id", F.lit(3).alias("three"), F.coalesce("q", F.lit(0)).alias("z")))
    assert found["three"][0] == "3" and found["z"][1] == "not null" and found["id"][1] == "may be null"


ENGINE = sorted(n for n in queries() if n in oracle_sql())


@pytest.mark.parametrize("name", ENGINE)
def test_query_against_sql(spark, folder, name):
    same(queries()[name](spark, folder), oracle_sql()[name], folder)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_build_histories(spark, tmp_path):
    from docweave.plans.reconcile import differences
    from docweave.plans.report import middle_id, report, sample, stats, translated
    from docweave.plans.stores import Flat, Nested, Raw
    from docweave.sources import tables as on_disk
    from docweave.sources.generate import BUILDS, BUILDS_CONFIG, builds

    text = builds(spark, 40, seed=3).cache()
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, builds(spark, 40, seed=3).repartition(3).collect()))
    c = corpus.from_rows(text)
    layout = laid_out(infer(c, BUILDS_CONFIG))
    assert [(f.name, f.type, f.nullable) for f in layout.by_name()["step"].fields] == [("id", "int", False), ("job_id", "int", False), ("idx", "int", False), ("error", "str", True), ("ms", "int", False), ("name", "str", False), ("rate", "float", False)]
    assert [f.name for f in layout.by_name()["repo"].fields] == ["id", "name", "org", "private"] and layout.by_name()["repo"].fields[0].type == "uuid"
    tables = shredded(c, layout)
    on_disk.written(tables, layout, str(tmp_path / "t"))
    back = on_disk.opened(spark, str(tmp_path / "t"))
    assert not back["step"].schema["ms"].nullable and back["step"].schema["error"].nullable
    verified(back, layout)
    stores = {"raw": Raw(text, BUILDS), "nested": Nested(text.select(F.from_json("value", BUILDS.record()).alias("d")), BUILDS), "flat": Flat(back, BUILDS)}
    some = middle_id(back["repo"])
    asked = {"document": lambda s: s.document(some), "scan": lambda s: s.scan(30_000), "computed": lambda s: s.computed(30_000), "by_name": lambda s: s.by_name(), "three_hop": lambda s: s.three_hop("cedar")}
    assert disagreements(stores, asked) == [] and differences(stores["nested"], stores["flat"]) == {}
    assert {r["table_name"]: r["n"] for r in stats(back).collect()}["repo"] == 40
    said = report(c, BUILDS_CONFIG)
    assert said["ok"] and said["documents"] == 40 and "create table" in said["ddl"]
    assert len(sample(c, BUILDS_CONFIG)["tables"]["repo"]) == 1
    assert translated('{"a":[[1]]}', spark) == {"ok": False, "error": {"code": "nestedArray", "path": ".a[]", "message": "nestedArray: .a[]: an array directly inside an array"}}
    on_disk.logged(spark, str(tmp_path / "log"), {"run": 1})
    on_disk.logged(spark, str(tmp_path / "log"), {"run": 2})
    assert on_disk.log(spark, str(tmp_path / "log")).count() == 2


def test_corpus_is_built_and_parsed_once(spark, folder, monkeypatch):
    """Whatever tables a query asks for, the tables of the folder are read once, and joins of one document shuffle no table below it."""
    from docweave import queries as q

    built = []
    customers = corpora.customers
    monkeypatch.setattr(corpora, "customers", lambda *a: built.append(a) or customers(*a))
    t, layout = q.tables(spark, folder, "customers")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(built) == 1 and all("lineitem" not in plan(df) and "parse_json" not in plan(df) for df in t.values())
    store = q.Flat(t, corpora.CUSTOMERS)
    for df in (store.document(7), store.document_semi(7)):
        assert plan(df).count("strategy=broadcast") >= 2
    assert store.document(7).collect() == [tuple(r) for r in store.document_semi(7).select("n1", "n2", "n3", "total").collect()]


def test_walk_together_counts_what_each_document_says(spark):
    values = ["1", "-5", "9223372036854775808", "-99999999999999999999", "1.5", "null", "true", '"a"', '""', '"123e4567-e89b-12d3-a456-426614174000"', '"' + "x" * 36 + '"', '{"n":{"k":1}}', '{"k":null}', '[1,{"k":2}]', "[]", '[{"k":[1,"a"]},{}]']
    docs = [f'{{"a":{x},"b":{y}}}' for x in values for y in values[::-1]] + ["{}", '{"b":1}']
    rows = lambda some: corpus.from_rows(spark.createDataFrame(list(enumerate(some)), "doc_ord long, value string"))
    whole = observed(rows(docs), ((".a",),))
    one = {}
    for i in range(0, len(docs), 43):
        one = merged(one, observed(rows(docs[i:i + 43]), ((".a",),)))
    assert whole == one
    a = whole[()].members["a"]
    assert (a.values, a.nulls, a.big) == (16 * 15, 16, True) and a.types == {"int", "float", "bool", "str", "uuid", "coll"}
    assert whole[(".a", "[]")].objects and whole[(".a", "[]")].scalars and whole[(".a", "{}")].visits == 32
    assert whole[(".b",)].members["k"].nulls == 16 and whole[(".b", ".n")].members["k"].types == {"int"}


def test_documents_are_counted_by_columns_as_by_a_walk(spark, monkeypatch):
    from docweave.operators import observe
    from docweave.operators.shred import records, records_of_texts

    uuid = "123e4567-e89b-12d3-a456-426614174000"
    plain = ['{"id":1,"xs":[{"k":1,"s":"%s"},{"k":-7}],"at":{"on":true}}' % uuid, '{"id":2,"xs":[],"tags":["a","2020-01-02"]}', '{"day":"2020-01-02","id":3}', '{"id":4,"xs":[{"s":"%s"}],"at":{}}' % ("x" * 36)]
    odd = ['{"id":5,"f":1.0,"g":2.5,"h":1e2}', '{"id":6,"at":null}', '{"id":7,"b":%d,"d":%s}' % (1 << 62, "9" * 39), r'{"id":8,"at":{"on":false}}', '{"id":9,"f":1.%s}' % ("0" * 40), '{"id":10,"at":{"on":true},"e":%s}' % ("1" * 300)]
    for texts, columns in ((plain, True), (plain + odd, False)):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_ord long, value string").coalesce(1)
        docs = corpus.from_rows(rows)
        seen = observe.Seen(())
        assert observe.by_columns(seen, texts) == columns and (seen.visits == len(texts)) == columns
        want = observe.observed(docs.drop("text"))  # as Spark's parser writes them
        assert observe.observed(docs) == want
        with monkeypatch.context() as m:
            m.setattr(observe, "by_columns", lambda *_: False)
            assert observe.observed(docs) == want
        layout = laid_out(infer(docs))
        assert list(map(str, records_of_texts(rows, layout).collect())) == list(map(str, records(docs, layout).collect()))
