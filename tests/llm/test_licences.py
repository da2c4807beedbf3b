from reviewlake.llm import licences


def test_whole_texts_and_lines(spark):
    mit = licences.KNOWN["MIT"][0]
    changed = mit.replace("Copyright (c) holder", "Copyright (c) 2001-2024 Some One\nAll rights reserved.").upper().replace("LICENSE", "LICENCE").replace(", ", " ;\n  ").replace("OR COPYRIGHT", "OR\nCOPYRIGHT")
    rows = [(1, mit), (2, changed), (3, "Text.\nReleased under the MIT Licence\nmore\nLicensed under CC BY 4.0"), (4, None), (5, ""), (6, mit + " not"), (6, mit + " not"), (None, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, digest string, notices string")
    found = licences.scan(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[1]["license_id"] == by[2]["license_id"] == "MIT" and by[1]["digest"] == by[2]["digest"]
    assert by[3]["license_id"] is None and by[3]["notices"] == ["CC-BY-4.0", "MIT"]
    assert by[4]["license_id"] is by[5]["license_id"] is by[6]["license_id"] is None and by[4]["digest"] == by[5]["digest"]
    assert licences.scan(docs.limit(0)).collect() == []


def test_known_digests_are_distinct(spark):
    found = licences.known_digests(spark).collect()
    assert len({r["digest"] for r in found}) == len(found)


def test_every_known_text_whole_on_one_line_and_as_a_line(spark):
    rows = []
    for name, texts in licences.KNOWN.items():
        for text in texts:
            own = text.replace("(c) holder", "(c) 2019 Some Holder")
            flat = " ".join(own.split())
            rows += [(name, "whole", own), (name, "whole", flat), (name, "line", f"Some words.\n{flat}\nand more")]
    docs = spark.createDataFrame([(k, text, "clash") for k, (*_, text) in enumerate(rows)], "doc_id long, text string, words string")
    found = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for k, (name, kind, text) in enumerate(rows):
        assert (found[k]["license_id"] == name) if kind == "whole" else (found[k]["license_id"] is None and name in found[k]["notices"]), text[:80]


def test_notices_go_and_the_rest_of_a_line_stays(spark):
    essay = "Copyright 2024 is a year in which many words were written about many things, " + "one after the other, " * 20
    texts = [essay + "first", essay + "second", "Copyright 2024 A", "Copyright 2025 B", "© 2020 Firm. Licensed under CC BY 4.0.", "Copyright 2024 A\nText", "Copyright 2025 B\nText", "Text", None, " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    digest = [found[k]["digest"] for k in range(len(texts))]
    assert len(set(digest[:4])) == 4 and digest[5] == digest[6] == digest[7] and digest[8] == digest[9] and digest[8] not in digest[:8]
    assert found[4]["license_id"] == "CC-BY-4.0" and found[4]["notices"] == ["CC-BY-4.0"]


def test_a_table_of_known_texts(spark):
    known = spark.createDataFrame(
        [("Z", "Do what you want.\n\nBut be kind."), ("A", "do what you want; but be kind"), ("long", "w " * 30_000), ("none", " \n"), ("null", None), (None, "x")],
        "license_id string, text string",
    )
    docs = spark.createDataFrame([(1, "DO WHAT you want, but be kind!"), (2, "One.\ndo what you want but be kind"), (3, "W " * 30_000), (4, ""), (5, "Licensed under CC BY 4.0."), (6, "x")], "doc_id long, text string")
    found = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licences.scan(docs, known=known).collect()}
    assert found == {1: ("A", ["A"]), 2: (None, ["A"]), 3: ("long", ["long"]), 4: (None, []), 5: (None, []), 6: (None, [])}
    assert {r["license_id"] for r in licences.scan(docs, known=known.limit(0)).collect()} == {None}
