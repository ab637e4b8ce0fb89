"""Large JSON arrays read in byte ranges equal the parsed whole."""

import json
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from queuetide.session import input_bytes, shared_dir, shuffles_dropped
from queuetide.sources.arrays import array_elements, write_array
from queuetide.sources.offers import load_offers, offers_of


@pytest.fixture()
def ranged(spark):
    """Byte ranges of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield set_to
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def awkward(rnd, depth=0):
    texts = ["", "}", "{", '"', "\\", '\\"', "}{", "a\\\\", "é日😀", "[", "]", "plain", '"}', "line\nbreak"]
    kind = rnd.randrange(5 if depth < 3 else 3)
    if kind == 0:
        return "".join(rnd.choice(texts) for _ in range(rnd.randrange(6)))
    if kind == 1:
        return rnd.choice([1, 2.5, None, True])
    if kind == 2:
        return rnd.choice(texts)
    if kind == 3:
        return [awkward(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(texts) + str(i): awkward(rnd, depth + 1) for i in range(rnd.randrange(4))}


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_elements_equal_the_parsed_whole(spark, ranged, tmp_path, size):
    rnd = random.Random(size)
    files = {}
    for name, indent in (("a.json", None), ("b.json", 2), ("c.json", None), ("d.json", None)):
        items = [{"id": i, "x": awkward(rnd)} for i in range({"c.json": 0, "d.json": 1}.get(name, 40))]
        if name == "d.json":
            items = [{"id": 0, "x": "long } text { " * 300}]  # over many ranges
        files[name] = items
        (tmp_path / name).write_text(json.dumps(items, indent=indent, ensure_ascii=rnd.random() < 0.5) + "\n", encoding="utf-8")
    ranged(size)
    got = {}
    for r in array_elements(spark, str(tmp_path)).orderBy("file", "position").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["element"]))
    assert got == {name: items for name, items in files.items() if items}


def test_offer_lists_equal_whole_files(spark, ranged, tmp_path):
    offer = {"numberOfBookableSeats": 3, "price": {"total": "12.50", "currency": "DKK"}, "itineraries": [{"segments": [
        {"carrierCode": "SK", "number": "1", "departure": {"iataCode": "CPH", "at": "2026-01-01T10:00:00"}, "arrival": {"iataCode": "OSL"}}]}]}
    rows = [{**offer, "id": f"o{i}"} for i in range(200)]
    (tmp_path / "offers.json").write_text(json.dumps(rows))
    ranged(1000)
    split = load_offers(spark, str(tmp_path), lists=True)
    assert split.select("file").distinct().count() == 1
    ids = [r["id"] for r in split.orderBy("position").select("offer.id").collect()]
    whole = offers_of(spark.read.text(str(tmp_path), wholetext=True))
    assert ids == [f"o{i}" for i in range(200)]
    assert split.select("offer").exceptAll(whole.select("offer")).count() == 0
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 20


def test_the_longest_array_is_a_tasks_share(spark, tmp_path):
    """Arrays are written by many tasks, the empty ones too, and hold every element but nulls."""
    texts = [json.dumps({"id": i, "x": ["}", '"', "日"][i % 3]}, ensure_ascii=False) for i in range(90)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)] * 3, "offer string").repartition(5).unionByName(
        spark.createDataFrame([], "offer string"))
    write_array(rows, "offer", str(tmp_path / "lists"))
    lists = [json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "lists").glob("part-*")]
    assert len(lists) >= 5 and max(map(len, lists)) < 40
    got = sorted(json.dumps(json.loads(r["element"]), ensure_ascii=False) for r in array_elements(spark, str(tmp_path / "lists")).collect())
    assert got == sorted(texts)


def test_offer_list_files_gathers_no_list(spark, monkeypatch, tmp_path):
    """The query's lists grow with its tasks, not two with the input."""
    import __spark_entry__ as entry

    made = []
    monkeypatch.setattr("queuetide.registry.reading.scratch_path", lambda *_: made.append(str(tmp_path / "lists")) or made[-1])
    monkeypatch.setattr("queuetide.registry.reading.view", lambda *_: spark.range(60).repartition(6).selectExpr(
        "id as order_key", """concat('{"numberOfBookableSeats":', id, ',"price":{"total":"', id, '.50"}}') as offer"""))
    got = entry.queries()["offer_list_files"](spark, "")
    assert sorted(r["seats"] for r in got.collect()) == list(range(60))
    assert len(list((tmp_path / "lists").glob("part-*"))) == 6


@pytest.mark.parametrize("cut", ["}", "\n", ",", "]"])
def test_elements_do_not_depend_on_the_cut(spark, ranged, tmp_path, cut):
    rnd = random.Random(len(cut) + ord(cut))
    files = {}
    for name, indent in (("a.json", 1), ("b.json", None), ("c.json", 0)):
        files[name] = [{"id": i, "x": awkward(rnd)} for i in range(50)] + [{"x": "\\\"}\\\\" * 200}, ["]", {"y": []}], 3, "[{"]
        (tmp_path / name).write_text(json.dumps(files[name], indent=indent, ensure_ascii=False), encoding="utf-8")
    ranged(300)
    got = {}
    for r in array_elements(spark, str(tmp_path), cut).orderBy("file", "position").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["element"]))
        text = (tmp_path / r["file"].rsplit("/", 1)[1]).read_bytes()
        assert text[r["position"]:].startswith(r["element"].encode())
    assert got == {name: items[:-2] for name, items in files.items()}


def test_elements_are_not_stored_again(spark, ranged, tmp_path):
    """Reading lists writes no second copy of them, torn elements or not."""
    (tmp_path / "list.json").write_text(json.dumps([{"id": i, "x": "}" * 50} for i in range(200)]))
    shared = pathlib.Path(shared_dir(spark))
    shared.mkdir(parents=True, exist_ok=True)
    for size in (1 << 20, 300):
        ranged(size)
        before = set(shared.iterdir())
        assert array_elements(spark, str(tmp_path)).count() == 200
        assert set(shared.iterdir()) == before


def test_a_large_table_goes_through_its_lists_in_shares(spark, monkeypatch, tmp_path):
    """The lists of one share at a time are on disk, and every offer comes back once, keys that repeat or are null too."""
    import __spark_entry__ as entry

    made, held = [], []

    def scratch(_, label):
        made.append(tmp_path / f"{label}-{len(made)}")
        held.append([p.name for p in made if p.exists() and p.name.startswith("lists")])
        return str(made[-1])

    spark.range(90).repartition(3).selectExpr(
        "case when id % 10 > 0 then id % 30 end as order_key",
        """concat('{"numberOfBookableSeats":', id, ',"price":{"total":"', id, '.50"}}') as offer""").write.parquet(str(tmp_path / "an offer"))
    offers = spark.read.parquet(str(tmp_path / "an offer")).repartition("order_key")
    assert input_bytes(offers) == sum(f.stat().st_size for f in (tmp_path / "an offer").glob("part-*"))
    monkeypatch.setattr("queuetide.registry.reading.scratch_path", scratch)
    monkeypatch.setattr("queuetide.registry.reading.view", lambda *_: offers)
    monkeypatch.setattr("queuetide.registry.reading.LIST_SHARE", input_bytes(offers) // spark.sparkContext.defaultParallelism // 4)
    got = entry.queries()["offer_list_files"](spark, "")
    assert sorted((r["seats"], r["total"]) for r in got.collect()) == [(i, f"{i}.50") for i in range(90)]
    assert len([p for p in made if p.name.startswith("lists")]) >= 4 and not any(held)
    assert not list(tmp_path.glob("lists*"))


def test_shuffles_go_with_their_query(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    folders = [pathlib.Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return {f for folder in folders for f in folder.glob("*/shuffle_*.data")}

    there = shuffled()
    kept = spark.range(1000).repartition("id")
    kept.write.parquet(str(tmp_path / "kept"))
    kept = shuffled() - there
    with shuffles_dropped(spark):
        spark.range(1000).repartition("id").write.parquet(str(tmp_path / "rows"))
    until = time.time() + 30
    while shuffled() - there - kept and time.time() < until:
        time.sleep(0.2)
    assert kept and not shuffled() - there - kept
    assert spark.conf.get(name, None) == before
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1000
