from netquilt.llm import quality


def test_toxic_texts_of_good_quality_are_rejected(spark, docs_of, prose, rnd):
    insults = ["moron", "scum", "idiot", "trash"]
    docs = []
    for i in range(900):
        words = prose(rnd.randint(20, 90)).split()
        for _ in range(3 if i % 9 == 0 else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        docs.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 50 != 1), int(i % 9 == 0)) for i, _ in docs if i % 2 == 0], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.score(docs_of(docs), labels).collect()}
    held = [i for i, _ in docs if i % 2]
    assert sum((rows[i]["toxic_score"] >= 0.5) == (i % 9 == 0) for i in held) / len(held) > 0.98
    assert sum(rows[i]["keep"] for i in held if i % 9 == 0) <= 0.1 * sum(i % 9 == 0 for i in held)
    kept = {r["doc_id"] for r in quality.drop_poor(docs_of(docs), labels).collect()}
    assert kept == {i for i, r in rows.items() if r["keep"]}
