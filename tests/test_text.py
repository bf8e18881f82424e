from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators.addresses import parse_addresses
from kinloom.operators.learned import break_words


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean(spark):
    got = apply(spark, text.clean, ["Café  Éloïse & Fils", "Joe's Diner", "NaN", None, "A.B-C", "Ünder_score 5", "राम मार्केटिंग"])
    assert got[:6] == ["cafe eloise and fils", "joe diner", "", "", "a b c", "under_score 5"]
    assert got[6] == "र म म र क ट ग"  # vowel signs are no letters


def test_core_and_forms(spark):
    assert apply(spark, text.core_name, ["The Acme Company Ltd", "Co Ltd", "Maison de Sante SARL", ""]) == ["acme", "co ltd", "maison sante", ""]
    assert apply(spark, text.legal_form, ["X Pvt. Ltd.", "X Private", "X LLC", "X S.A.", "X Limited", "Y GmbH Inc"]) == ["PVT_LTD", "", "LLC", "", "LTD", "INC"]
    assert apply(spark, text.core_addr, ["12 N Main St, near the Park", "near the"]) == ["12 north main street park", "near the"]
    assert apply(spark, text.acronym, ["Indian Coffee House", ""]) == ["ich", ""]
    assert [sorted(x) for x in apply(spark, text.numeric_tokens, ["a12b 7 12", "none", None])] == [["12", "7"], [], []]


def test_domain_and_script(spark):
    assert apply(spark, text.domain_stem, ["www.Delta-Trade.com", "delta.org ", "delta trade", "x.y.com"]) == ["deltatrade", "delta", "", ""]
    assert apply(spark, text.script_class, ["", "abc", "delta.com", "राम abc", "abc தமிழ்", "漢字"]) == ["empty", "latin", "domain", "devanagari", "tamil", "other-nonlatin"]


def test_skeleton_makes_spellings_equal(spark):
    a, b = apply(spark, text.skeleton, ["chandigarh motors", "candigar moters"])
    assert a.split()[1] == b.split()[1] == "mtrs"
    assert apply(spark, text.skeleton, ["phone nation", "aab", ""]) == ["fn nsn", "ap", ""]


def test_letters_and_leet(spark):
    assert apply(spark, text.name_tokens, ["P L L C Works", "a b cd e", "R&D + Co", "O'Neil"]) == [["pllc", "works"], ["ab", "cd", "e"], ["r", "and", "d", "and", "co"], ["oneil"]]
    assert apply(spark, text.leet, ["g00gle", "1st", "500", "abc", "b4nk5"]) == ["google", "1st", "500", "abc", "b4nks"]
    got = apply(spark, text.canonical_name, ["The Acme Corporation Limited", "Ltd", "of the"])
    assert [(g.full, g.core, g.key, g.legal) for g in got] == [("the acme corp ltd", "acme", "acme", "corp ltd"), ("ltd", "ltd", "ltd", "ltd"), ("of the", "of the", "of the", "")]


def test_addresses(spark):
    cases = [
        ("No. 12-4, 3rd Main Rd, Near City Park, Bangalore, KA 560001", "India", {"state": "karnataka", "postcode": "560001", "city": "bangalore", "house": "12-4", "house_digits": "12", "landmark": True, "street": "3 main road city park"}),
        ("0045 W Oak St Apt 7B, Springfield, IL 62704", "US", {"state": "il", "postcode": "62704", "city": "springfield", "house": "45", "unit": "7b"}),
        ("12 bis r de la Paix, 59000 Lille, Nord", "France", {"state": "hauts de france", "postcode": "59000", "city": "lille", "house": "12", "house_suffix": "bis", "street": "rue de la paix"}),
        ("New York, 5 Main St, NY", "US", {"state": "ny", "city": "new york"}),
        ("Oregon, Salem, 5 Main St, OR", "US", {"state": "or", "places": "salem|oregon"}),
        ("Hyderabad, Telangana", "India", {"state": "andhra pradesh telangana"}),
        ("Hyderabad, AP", "India", {"state": "andhra pradesh telangana"}),
        (None, "US", {"is_empty": True, "state": "", "house": "", "words": ""}),
        ("null, ,", "US", {"components": 0}),
        ("12 High St, Town", "Narnia", {"house": "12", "street": "high st", "city": "town"}),
        ("12 High St, Town", None, {"house": "12"}),
        ("00207 R. DU MOULIN, TOURCOING, Hauts-de-France", "France", {"house_digits": "207", "state": "hauts de france", "city": "tourcoing", "street": "rue du moulin"}),
        ("N° 8 R DES VIGNES, Dijon", "France", {"house_digits": "8", "city": "dijon"}),
        ("Angers, 21 - R PASTEUR", "France", {"house_digits": "21", "city": "angers", "street": "rue pasteur"}),
        ("44BIS R ÉMILE ZOLA, PÉRIGUEUX, Nouvelle-Aquitaine", "France", {"house_digits": "44", "house_suffix": "bis", "city": "perigueux", "state": "nouvelle aquitaine"}),
        ("812 CEDAR ST, null, DAYTON, OH", "US", {"house": "812", "state": "oh", "city": "dayton", "street": "cedar street", "components": 3}),
        ("TX, LAMAR AVE, AUSTIN", "US", {"house": "", "state": "tx", "street": "lamar avenue", "city": "austin"}),
        ("52 East Lake Hills Cir, Alaska, Juneau", "US", {"state": "ak", "street": "east lake hills circle"}),
        ("BOISE, ID, 17 1/2 ELM TRAIL", "US", {"house": "17", "city": "boise"}),
        ("900 Field Drive, Unit APARTMENT G, Salem, MA", "US", {"house": "900", "unit": "g", "street": "field drive"}),
        ("Unit 12, Macon, GA, 77 Hunt Road", "US", {"house": "77", "unit": "12"}),
        ("14 52ND TERRACE, null, OMAHA CITY, NE", "US", {"street": "52 terrace", "city": "omaha"}),
        ("#331 PINE STREET, TULSA CDP, OK", "US", {"house_digits": "331", "city": "tulsa"}),
        ("KH NO. -42/7, NEW DELHI, WEST DELHI, Delhi", "India", {"house_digits": "42", "state": "delhi", "places": "new delhi|west delhi"}),
        ("House No #9, 3Rd Floor, Block E, Delhi, North West Delhi, DL", "India", {"house_digits": "9", "state": "delhi"}),
    ]
    rows = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], "id int, addr string, country string")
    got = {r.id: r.asDict() for r in parse_addresses(rows).collect()}
    wrong = [(a, k, got[i][k], v) for i, (a, _, want) in enumerate(cases) for k, v in want.items() if got[i][k] != v]
    assert wrong == []


def test_words_are_broken_at_least_cost():
    costs = {"delta": 2.0, "trade": 2.5, "de": 3.0, "a": 1.0}
    assert break_words("deltatrade", costs) == ["delta", "trade"]
    assert break_words("", costs) == [] and "".join(break_words("xqz", costs)) == "xqz"
