from kinloom.llm.license_scan import KNOWN, scan_licenses


def test_spelling_case_and_copyright_lines(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and len(t) > 500)
    varied = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace(", ", " ,\n ")
    rows = [
        (1, varied, "x"), (2, mit + " extra", "x"), (3, "some words\nLicensed under the Apache Licence -- Version 2.0\nmore\nReleased under the MIT License.", "x"),
        (4, None, "x"), (5, "", "x"), (6, "...", "x"), (None, "Released under the MIT license", "x"), (1, varied, "x"), (7, "word " * 300_000, "x"), (8, "released under the mit license\nReleased under the MIT License.", "x"),
    ]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    got = sorted(((r.doc_id, r.license, r.n_license_lines, r.line_licenses) for r in out), key=repr)
    assert got == sorted(
        [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, None, 0, ""), (3, None, 2, "Apache-2.0,MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (None, "MIT", 1, "MIT"), (7, None, 0, ""), (8, None, 2, "MIT")],
        key=repr,
    )


def test_empty(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sentences_about_notices_stay_and_spellings_are_words(spark):
    isc = next(t for n, t in KNOWN if n == "ISC" and len(t) > 500)
    lines = isc.replace("provided that the above copyright notice", "provided that the above\ncopyright notice")
    rows = [(1, "ISC License\n\nCopyright 2019 Some One\n\n" + lines), (2, "(c) you must keep it"), (3, "you must keep it"), (4, "Copyright holder and (c) 2020"), (5, "sublicence licence licence favourite"), (6, "sublicence license license favourite")]
    out = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].license == "ISC" and lines != isc
    assert out[2].digest != out[3].digest and out[4].digest != scan_licenses(spark.createDataFrame([(1, "")], "doc_id long, text string")).first().digest
    assert out[5].digest == out[6].digest
