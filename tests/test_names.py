"""Name variants on names written by hand."""

import math

from kinloom.operators import names


def rows(spark, table, costs=None):
    dictionary = spark.createDataFrame([("भारत", "bharat", 3)], "token string, latin string, n long")
    records = spark.createDataFrame(list(enumerate(table)), "id long, name string")
    return {r.id: r for r in names.name_variants(records, dictionary, costs).collect()}


def test_variants(spark):
    got = rows(spark, ["** M/s. Acme Trading Co Ltd", "Acme Ltd d.b.a. Blue Sky", "Acme | https://www.acme-shop.com/x", "Sma1l Wor1d", "भारत गज Ltd", "ＡＣＭＥ", None, "", "The Of", "www.blue-sky.com", "P L L C"])
    view = lambda i: (got[i].core, got[i].full, got[i].legal, got[i].alt, got[i].flags)
    assert view(0) == ("acme trading", "acme trading co ltd", "co ltd", "", 0)
    assert view(1) == ("acme dba blue sky", "acme ltd dba blue sky", "ltd", "acme|blue sky", 2)
    assert view(2) == ("acme", "acme", "", "acmeshop", 0)
    assert view(3) == ("small world", "small world", "", "sma1l wor1d", 4)
    assert view(4) == ("bharat gaja", "bharat gaja ltd", "ltd", "", 24) and math.isclose(got[4].oov, 0.5) and got[4].shown == "bharat gaja ltd (भारत गज Ltd)"
    assert view(5)[0] == "acme"
    assert [tuple(got[i])[1:] for i in (6, 7)] == [("", "", "", "", "", "", 0, 0.0, 0, "")] * 2
    assert view(8) == ("the of", "the of", "", "", 0)
    assert view(9)[0] == "bluesky" and got[9].flags == 1
    assert view(10) == ("pllc", "pllc", "pllc", "", 0)


def test_domains_are_split(spark):
    costs = spark.createDataFrame([("blue", 2.0), ("sky", 2.0)], "word string, cost double")
    got = rows(spark, ["blue-sky.com", "Acme"], costs)
    assert (got[0].core, got[0].squeezed, got[0].n_core, got[0].flags) == ("blue sky", "bluesky", 2, 1)
    assert got[1].core == "acme"
