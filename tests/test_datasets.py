"""Loading data sets as they lie on disk, sinks, preparation, providers."""

import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import providers
from quernstone.sources import datasets, registry, sinks
from quernstone.sources import preparation as P


def write(path, text, encoding="latin-1"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_public_sources():
    r = registry.public_sources()
    assert len(r.sources) == 24 and r.get("baby_products").domain == "baby products" and r.get("beer").table_b == "rate_beer"
    assert sorted(n for n, s in r.sources.items() if s.held_out) == sorted(registry.HELD_OUT)
    with pytest.raises(ValueError, match="unknown source"):
        datasets.fetch("nothing", "/tmp")


def test_fetch_unpacks_once(tmp_path):
    write(f"{tmp_path}/made/beer/csv_files/beer_advocate.csv", "id,val\n1,a\n")
    calls = []

    def retrieve(url, to):
        calls.append(url)
        with tarfile.open(to, "w:gz") as t:
            t.add(f"{tmp_path}/made/beer", "beer")

    for _ in range(2):
        assert os.listdir(datasets.fetch("beer", f"{tmp_path}/data", retrieve=retrieve)) == ["beer_advocate.csv"]
    assert calls == [registry.public_sources().get("beer").url] and not os.path.exists(f"{tmp_path}/data/beer.tar.gz")


def test_load_by_name_of_the_folder(spark, tmp_path):
    folder = f"{tmp_path}/beer/csv_files"
    write(f"{folder}/beer_advocate.csv", "# made\n_id,name\n1,é\n2,b\n3,c,too,many\n")
    write(f"{folder}/rate_beer.csv", "ID,name\n1,x\n")
    write(f"{folder}/labeled_data.csv", "_id,ltable._id,rtable.ID,gold\n" + "".join(f"{i},{i % 3},{i % 2},{i % 2}\n" for i in range(10)))
    got = datasets.load(spark, folder)
    assert set(got) == {"tableA", "tableB", "labeled_data", "train", "valid", "test"}
    assert got["tableA"].columns == ["id", "name"] and got["tableA"].count() == 2 and got["tableB"].columns == ["id", "name"]
    assert [got[s].count() for s in ("train", "valid", "test")] == [6, 2, 2] and got["train"].columns == ["ltable_id", "rtable_id", "label"]
    assert "train" not in datasets.load(spark, folder, split=False)


def test_load_unknown_and_empty_folders(spark, tmp_path):
    write(f"{tmp_path}/strange/one.csv", "id,val\n1,a\n")
    write(f"{tmp_path}/strange/candset.csv", "id\n1\n")
    os.makedirs(f"{tmp_path}/empty")
    assert set(datasets.load(spark, f"{tmp_path}/strange")) == {"one"}
    assert datasets.load(spark, f"{tmp_path}/empty") == {} and datasets.load(spark, f"{tmp_path}/nowhere") == {}
    assert datasets.load_parquet(spark, f"{tmp_path}/nowhere.parquet") is None


def test_load_local(spark, tmp_path):
    for n in "abl":
        write(f"{tmp_path}/{n}.csv", "id,title\n1,x\n")
    got = datasets.load_local(spark, *(f"{tmp_path}/{n}.csv" for n in "abl"))
    assert {k: d.count() for k, d in got.items()} == {"tableA": 1, "tableB": 1, "labels": 1}


def test_load_prepared(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.5, 1.0])], "id long, v array<double>")
    for s in "ab":
        write(f"{tmp_path}/t/beer/table{s.upper()}.csv", "id,val\n1,a\n")
        sinks.write_vectors(v, f"{tmp_path}/v/beer/row_embeddings_{s}")
        assert datasets.load_prepared(spark, "beer", f"{tmp_path}/t", f"{tmp_path}/v") is None
        sinks.write_vectors(v.select(F.lit("val").alias("col"), "v"), f"{tmp_path}/v/beer/column_embeddings_{s}", "col")
    write(f"{tmp_path}/t/beer/train.csv", "ltable_id,rtable_id,label\n1,1,1\n")
    got = datasets.load_prepared(spark, "beer", f"{tmp_path}/t", f"{tmp_path}/v")
    assert set(got["splits"]) == {"train"} and got["row_embeddings_a"].first().v == [0.5, 1.0] and got["table_b"].count() == 1


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(2, [3.0, 4.0]), (1, [1.0, 2.0])], "id long, v array<double>")
    sinks.write_numpy(v, f"{tmp_path}/v.npy")
    assert np.load(f"{tmp_path}/v.npy").tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.write_numpy(v, f"{tmp_path}/v.npy", most=1)
    e = spark.createDataFrame([(1, 2, "a")], "dst long, src long, col string")
    assert sinks.write_graph(f"{tmp_path}/g", v, v, v, e) == {"n_rows": 2, "n_tokens": 2, "n_columns": 2, "n_edges": 1}
    assert sinks.read_graph(spark, f"{tmp_path}/g")["edges"].collect() == e.collect()
    for _ in range(2):
        sinks.append_traces(e, f"{tmp_path}/traces")
    assert spark.read.json(f"{tmp_path}/traces").count() == 2


def test_layout_moves_once(spark, tmp_path):
    for kind in ("rows", "graphs"):
        write(f"{tmp_path}/{kind}/beer/x.txt", "1")
    assert len(sinks.migrate_layout(spark, str(tmp_path), "small/model", dry_run=True)) == 2
    moves = sinks.migrate_layout(spark, str(tmp_path), "small/model")
    assert len(moves) == 2 and os.path.exists(f"{tmp_path}/rows/small_model/beer/x.txt")
    assert sinks.migrate_layout(spark, str(tmp_path), "small/model") == []


def test_recipes(spark, tmp_path):
    assert set(P.RECIPES) == {"lamoda", "cars_ru", "ozon", "auto_ru", "auto_ru_2020", "devices"}
    df = spark.createDataFrame([(1, "{'size': 4, 'made': {'in': \"it's\"}}", "s1", "x"), (2, None, "s2", "x"), (3, '{"size": 5}', "s3", "x")], "id int, About string, Similar string, same string")
    got = P.prepare(df, P.RECIPES["lamoda"])
    assert "About.size" in got.columns and not {"id", "same", "Similar"} & set(got.columns)
    assert sorted(str(r["About.size"]) for r in got.collect()) == ["4", "5", "None"]
    cars = spark.createDataFrame([(1, "['abs', 'esp']", "a"), (2, "{'abs': True}", "b"), (3, None, "c")], "custom int, options string, mark string")
    got = P.prepare(cars, P.RECIPES["cars_ru"])
    assert {(r.mark, r.opt_abs, r.opt_esp) for r in got.collect()} == {("a", True, True), ("b", True, False), ("c", False, False)} and "custom" not in got.columns
    assert P.drop_leaking(cars, "mark").columns == ["custom", "options"]
    write(f"{tmp_path}/o/one.csv", "name,brand\na,x\nb,y\n", "utf-8")
    write(f"{tmp_path}/o/two.csv", "name,price\nc,1\n", "utf-8")
    got = P.prepare_source(spark, f"{tmp_path}/o", "ozon")
    assert {r["__source_file"] for r in got.collect()} == {"one.csv", "two.csv"} and got.count() == 3
    write(f"{tmp_path}/d/devices.json", json.dumps({"id": 1, "specs": {"ram": 4}, "kind": "a"}) + "\n" + json.dumps({"id": 2, "specs": {"ram": 8}, "kind": "a"}) + "\n", "utf-8")
    assert P.prepare_source(spark, f"{tmp_path}/d", "devices").columns == ["specs.ram"]


def test_model_server(monkeypatch):
    m = providers.HttpModel(model="m", embedding_model="e")
    sent = []
    monkeypatch.setattr(m, "post", lambda path, body: sent.append((path, body)) or ({"response": "hi"} if "generate" in path else {"embeddings": [[1.0]] * len(body["input"])}))
    assert m.generate("p") == "hi" and m.embed("x") == [1.0] and m.embed_batch(["x", "y"]) == [[1.0], [1.0]]
    assert sent[0] == ("/api/generate", {"model": "m", "prompt": "p", "stream": False}) and sent[1][1]["model"] == "e"
    for blank in ("", "  "):
        with pytest.raises(ValueError, match="no text"):
            m.embed(blank)


def test_objects_of_replies():
    replies = iter(["nothing", '<think>{"a": 0}</think> [{"a": 1, "b": 2}, {"a": 3}] done'])
    assert providers.reply_object(lambda _: next(replies), "p") == {"a": 3, "b": 2}
    assert providers.reply_object(lambda _: 'so {"x": [1, 2]} it is', "p", 0) == {"x": [1, 2]}
    asked = []
    assert providers.reply_object(lambda p: asked.append(p) or "{broken", "p", 2) == {} and len(asked) == 3


def test_static_vectors(spark):
    t, v = spark.createDataFrame([("a",), ("z",)], "tok string"), spark.createDataFrame([("a", [1.0])], "tok string, v array<double>")
    assert {r.tok: r.v for r in providers.token_vectors(t, v).collect()} == {"a": [1.0], "z": None}


def test_no_key_is_dropped(spark):
    """More keys or options than columns are allowed: the rest is kept beside."""
    from quernstone.sources.preparation import flag_column, flatten_column

    df = spark.createDataFrame([(1, '{"a": 1, "b": 2, "c": 3}', '["x", "y"]'), (2, '{"a": 4}', '["x", "z", "w"]')], "id long, o string, l string")
    got = {r["id"]: r for r in flatten_column(df, "o", 2).collect()}
    assert set(got[1].asDict()) == {"id", "l", "o.a", "o.b", "o.rest"} and '"c"' in got[1]["o.rest"] and got[2]["o.a"] == "4"
    assert "o.rest" not in flatten_column(df, "o", 3).columns
    got = {r["id"]: r for r in flag_column(df, "l", "p", 2).collect()}
    assert set(got[1].asDict()) == {"id", "o", "p_x", "p_w", "p.rest"} and got[1]["p.rest"] == ["y"] and sorted(got[2]["p.rest"]) == ["z"] and got[2]["p_w"]
    assert "p.rest" not in flag_column(df, "l", "p", 4).columns
