from queryscore.llm import licences

MIT = licences._MIT


def _found(docs, known):
    return {r.doc_id: (r.licence, r.notices) for r in licences.scan(docs, known, ["doc_id"]).collect()}


def test_whole_texts_and_notices(spark, documents):
    respelled = MIT.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace('"', "'")
    rows = [
        (1, MIT), (2, f"MIT License\n\nCopyright (c) 2020 A. Person\n\n  {respelled.upper()}\n"), (3, MIT + " And more."),
        (4, "Some prose.\nReleased under the MIT LICENCE!\nMore.\nAll rights reserved."), (5, "the license of poets"), (6, None), (7, ""),
        (8, "(c) 1999 Somebody"), (9, MIT.replace("MERCHANTABILITY", "nothing")), (9, "Released under the MIT License."), (10, "word " * 50_000),
    ]
    found = licences.scan(documents(rows), licences.builtin(spark), ["doc_id"]).collect()
    assert len(found) == len(rows)
    got = sorted((r.doc_id, r.licence or "", r.notices) for r in found)
    assert got == [
        (1, "MIT", ""), (2, "MIT", ""), (3, "", ""), (4, "", "MIT,all-rights-reserved"), (5, "", ""), (6, "", ""), (7, "", ""),
        (8, "", ""), (9, "", ""), (9, "MIT", "MIT"), (10, "", "")]


def test_empty_tables_ties_and_clashing_columns(spark, documents):
    none = spark.createDataFrame([], "licence string, text string")
    assert _found(documents([(1, MIT)]), none) == {1: (None, "")}
    assert _found(documents([]), licences.builtin(spark)) == {}
    tied = spark.createDataFrame([("b", "one text"), ("a", "One, text!"), ("c", None), ("d", " ")], "licence string, text string")
    assert _found(documents([(1, "ONE TEXT"), (2, None)]), tied) == {1: ("a", ""), 2: (None, "")}
    clash = spark.createDataFrame([(1, "one text", "x")], "doc_id long, text string, licence string")
    assert licences.scan(clash, tied, clash.columns).first().licence == "a"


def test_notices_without_words_of_rights_are_found(spark, documents):
    known = spark.createDataFrame([("GPL-3.0", "GPL-3.0-or-later"), ("CC0-1.0", "CC0 1.0 Universal")], "licence string, text string")
    rows = [(1, "# gpl-3.0-or-later\nprose"), (2, "a\n -- CC0   1.0 Universal!" + "-" * 500 + "\nGPL 3.0 or later"), (3, "CC0 1.0")]
    assert _found(documents(rows), known) == {1: (None, "GPL-3.0"), 2: (None, "CC0-1.0,GPL-3.0"), 3: (None, "")}
