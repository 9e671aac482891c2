import corpus_pipeline
import pytest

from netquilt.llm import bpe, decontaminate, quality, secrets

LABELS = "doc_id long, quality int, toxic int"


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture
def folder(spark, tmp_path, prose, rnd):
    texts = [(i, prose(rnd.randint(40, 90)).capitalize() + ".") for i in range(120)]
    items = [(0, prose(30)), (1, prose(12))]
    texts += [(200 + i, " ".join(w.upper() + "!!" for w in prose(40).split())) for i in range(40)]
    texts += [(300, texts[4][1]), (301, texts[5][1] + " odd"), (302, prose(30) + "\n" + items[0][1] + " " + prose(9)), (303, prose(50) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(9)), (304, None), (305, "")]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in texts if i % 2 == 0 and i < 300], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_equal_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model, _ = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    ids = sorted(rows)
    keep = model.score([(quality.content(rows[i]["text"]), "en", "src1", rows[i]["n_chars"]) for i in ids], [quality.word_slots(rows[i]["text"]) for i in ids])[2] >= quality.THRESHOLD
    ids = [i for i, k in zip(ids, keep, strict=True) if k]
    assert not any(200 <= i < 300 for i in ids) and sum(i < 200 for i in ids) >= 118
    root, cut = {i: i for i in ids}, {i: five(rows[i]["text"]) for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min(root[j] for j in ids if 5 * len(cut[i] & cut[j]) >= 4 * len(cut[i] | cut[j]))
    ids = [i for i in ids if root[i] == i]
    assert 300 not in ids and 301 not in ids
    items = [decontaminate.words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaked(text):
        w = decontaminate.words(text)
        code = {x: n for n, x in enumerate({*w, *(y for t in items for y in t)}, 1)}
        return any(decontaminate.best_stretch([code[x] for x in t], [code[x] for x in w])[0] <= len(t) // 5 for t in items)

    ids = [i for i in ids if not leaked(rows[i]["text"])]
    assert 302 not in ids
    own = bpe.transducer(bpe.default_vocabulary())
    want = {}
    for i in ids:
        text = rows[i]["text"]
        text = secrets.masked(text, secrets.find_spans([text])[0]) if text else text
        want[i] = (text, own.ids(text or ""))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: (r["text"], r["token_ids"]) for i, r in got.items()} == want
    assert "[secret]" in got[303]["text"] and all(r["round_trip"] for r in got.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
