"""Learned operators on held-out rows, leaks with edits, and the pipeline's stages."""

import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from queuetide.llm.decontaminate import Items, batch_matches, budget, edit_match, find_leaks, without_leaks
from queuetide.llm.language import fit_filters, predict_language
from queuetide.llm.toxicity import score_toxicity, without_toxic
from queuetide.llm.words import split_words

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "lo", "ti", "nu", "se"], "bb": ["schr", "eng", "pfu", "ach", "ung"], "cc": ["éau", "ié", "oux", "ré", "çon"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, lang, rng.randint(3, 80)), lang if i % 17 else None) for i in range(600) for lang in [rng.choice("abc") * 2]]
    truth = {i: t for i, t, _ in rows}
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 ...", "aa"), (902, "", None), (903, "Ω", "bb")], "doc_id long, text string, lang string")
    train = df.where("doc_id % 4 != 2")
    got = {r["doc_id"]: r for r in predict_language(df, fit_filters(train)).collect()}
    lang = {i: next(k for k, s in SYLLABLES.items() if any(t.startswith(x) for x in s)) for i, t in truth.items()}
    held = [i for i in truth if i % 4 == 2]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert predict_language(df, fit_filters(df)).collect()[0]["lang_pred"] == "und"


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    rude = ["grobian", "flegel", "luempel", "rowdy"]
    rows, labels = [], []
    for i in range(900):
        words, toxic = text_of(rng, "aa", rng.randint(5, 120)).split(), i % 7 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(rude) + rng.choice(["", "s", "ig", ","]))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic) if i % 11 else None))
    rows += [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    caught = [got[i]["predicted"] for i in held if i % 7 == 0]
    clean = [got[i]["predicted"] for i in held if i % 7]
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.01 * len(clean)
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0
    assert without_toxic(docs, labels).count() == len(rows) - sum(r["predicted"] for r in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in score_toxicity(docs, none).collect()] == [0, 0]
    assert score_toxicity(docs.limit(0), none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_match_is_the_best_run():
    rng = random.Random(4)
    for _ in range(60):
        item, region = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, n))] for n in (7, 12))
        d, start, end = edit_match(item, region)
        runs = [region[a:b] for a in range(len(region) + 1) for b in range(a, len(region) + 1)]
        assert d == min(distance(item, r) for r in runs) == distance(item, region[start:end])


def test_leaks_with_edits():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 70))] for _ in range(60)]
    texts, at_limit, of = [], [], []
    for _ in range(300):
        k = rng.randrange(60)
        w = list(items[k])
        n = rng.randint(0, budget(len(w)))
        for _ in range(n):
            p = rng.randrange(len(w))
            rng.choice([lambda: w.__setitem__(p, rng.choice(vocabulary)), lambda: w.__delitem__(p), lambda: w.insert(p, rng.choice(vocabulary))])()
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] + w + [rng.choice(vocabulary) for _ in range(40)]).upper())
        of.append(k)
    found = batch_matches(split_words(pa.array(texts), lower=True), Items(list(range(60)), [" ".join(i) for i in items]))
    assert sum((t, k) in found for t, k in enumerate(of)) >= 0.98 * len(of)
    assert len(found) == sum((t, k) in found for t, k in enumerate(of))


def test_short_items_match_where_their_words_stand(spark, docs):
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta  gamma"), (3, "one two three"), (4, "one two three four"), (5, ""), (6, "alpha")],
                                  "item_id long, text string")
    texts = ["alpha", "x ALPHA alpha", "beta", "gamma beta", "a beta gamma beta gamma", "one two three", "zero one two three four", "alphabet",
             "beta", None, "one two  x three four"]
    rng = random.Random(1)
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma", "one", "two", "three", "four"]) for _ in range(30)) for _ in range(20)]

    def places(text, item):
        words, own = (text or "").lower().split(), item.lower().split()
        return next(((i, i + len(own)) for i in range(len(words) - len(own) + 1) if own and words[i:i + len(own)] == own), None)

    items = {r["item_id"]: r["text"] for r in bench.collect()}
    want = {(t, k, 0, *places(text, item)) for t, text in enumerate(texts) for k, item in items.items() if places(text, item)}
    assert {tuple(r) for r in find_leaks(docs(texts), bench).collect()} == want
    kept = without_leaks(docs(texts[:11]), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7, 8, 9, 10]


def test_leaks_of_a_table(spark, docs, clashing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    df = clashing(docs(["nothing here", None, "", f"x {item} y", item.replace("delta", "x"), item.replace("beta", "x").replace("iota", "y"),
                        item.replace("beta", "x").replace("delta", "z").replace("theta", "y")]))
    got = {tuple(r) for r in find_leaks(df, bench).collect()}
    assert got == {(3, 1, 0, 1, 11), (4, 1, 1, 0, 10), (5, 1, 2, 0, 10)}
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 6]
    assert find_leaks(df, bench.limit(0)).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def kept_by_stage(spark):
    import corpus_pipeline as p
    from queuetide.llm.common import documents, written

    docs, out = documents(spark, SF), []
    for name, stage in p.STAGES[:-1]:
        after = written(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stages_keep_the_columns(kept_by_stage):
    for _, before, after in kept_by_stage:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < after.count() <= before.count()


def test_pipeline_stages_take_awkward_rows(spark, tmp_path, prose):
    """Nulls in every column, repeated rows and doc_ids, columns with the stages' own names, and no rows at all."""
    import corpus_pipeline as p

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    text = prose[8] + "\nsecond line\nthird line"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (None, None, None, None, None), (2, None, "en", "b", None),
            (3, "", "en", "b", 0), (4, f"x {item} y", "en", "b", 9), (4, "quite other words here", "en", "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name in ("_gone", "_hash", "_text", "rank", "part", "component", "n_removed", "features", "pattern"):
            docs = docs.withColumn(name, F.lit("clash"))
        counts = []
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == p.COLUMNS
            counts.append(docs.count())
        packed = p.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert counts == ([8, 8, 8, 7] if data else [0] * 4) and (len(packed) >= 7 if data else packed == [])


def test_pipeline_line_stage(kept_by_stage):
    from tests.llm.test_operators import lines_by_force

    _, before, after = kept_by_stage[1]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = lines_by_force([t for _, t in rows])
    want = {rows[i][0]: t for i, (_, gone, t) in want.items() if not gone or t.strip()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert after.where("n_chars != length(text)").count() == 0


def test_pipeline_near_stage(kept_by_stage):
    from tests.llm.test_operators import groups_by_force

    _, before, after = kept_by_stage[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    want = {rows[i][0] for i, (_, _, kept) in groups_by_force([t for _, t in rows], 5, 80).items() if kept}
    assert {r["doc_id"] for r in after.collect()} == want


def test_pipeline_leak_stage_leaves_no_whole_item(spark, kept_by_stage):
    _, before, after = kept_by_stage[3]
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda t: any(i in " ".join((t or "").lower().split()) for i in items)
    kept = {r["doc_id"]: r["text"] for r in after.collect()}
    assert not any(holds(t) for t in kept.values())
    assert all(holds(r["text"]) for r in before.collect() if r["doc_id"] not in kept)
