from importlib import resources

from kinloom.llm.license_scan import NOTICES, scan_licenses


def test_files_of_common_licenses_match(spark):
    body = lambda name: next(t for n, t in NOTICES if n == name and len(t) > 500)
    file = lambda name: resources.files("kinloom.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")
    whole = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    texts = [(n, file(n)) for n in whole]
    for n, title in (("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License")):
        texts.append((n, f"{title}\n\nCopyright (c) 2020 Someone\n\n{body(n)}"))
    texts += [(n, f"{n.replace('-', ' ', 1).replace('Clause', 'Clause License')}\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{file(n)}") for n in ("BSD-2-Clause", "BSD-3-Clause")]
    texts.append(("BSD-3-Clause", "Copyright 2020 X\n\n" + file("BSD-3-Clause").replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")))
    out = scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.license for r in out.collect()} == {i: n for i, (n, _) in enumerate(texts)}
