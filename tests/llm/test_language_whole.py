from tactigrid.llm import language


def named(spark, texts, sample=language.SAMPLE):
    rows = [(i, text, lang, None) for i, (text, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language.identify(language.of_documents(docs), ["doc_id"], sample).collect()}
    return [(got[i], lang) for i, (_, lang) in enumerate(texts)]


def test_more_than_sixteen_languages(spark):
    got = named(spark, [(f"{c}{d}{c} {d}{d}{c} {c}{c}{d} " * 20, f"{c}{d}") for c in "abcde" for d in "vwxyz" for _ in range(5)])
    assert all(language_ == lang for language_, lang in got)


def test_a_rare_language_of_a_sampled_corpus(spark):
    got = named(spark, [(f"the owls watch the river {i} " * 10, "en") for i in range(600)] + [("der alte hund schläft " * 10, "de")] * 5, 40)
    assert all(language_ == lang for language_, lang in got)
