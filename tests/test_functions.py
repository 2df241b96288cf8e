"""Value vectors of the scalar functions, on Spark and in plain Python."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lodestone.functions import color, distance, keys, noise, periods, phonetics, text


def values(spark, inputs, column):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, s string").select("i", column(F.col("s")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


NORMAL = {
    "bügel": "buegel", "Bügel": "buegel", "weiß": "weiss", "größe": "groesse", "träger": "traeger", "crème": "creme", "piña": "pina", "søster": "soster",
    "Push-Up": "push up", "BH-Set, 2-teilig!": "bh set 2 teilig", "Größe 38": "groesse 38", "!!! ???": "", "": "", "ẞx": "ßx", "ü": "u",
}


def test_normalize(spark):
    assert values(spark, NORMAL, text.normalize) == [text.normalized(k) for k in NORMAL]
    assert {k: text.normalized(k) for k in list(NORMAL)[:13]} == {k: NORMAL[k] for k in list(NORMAL)[:13]}


def test_tokenize(spark):
    inputs = ["BH und die Spitze und BH", "bh spitze", "", "und"]
    assert values(spark, inputs, text.tokenize) == [text.tokens_of(x) for x in inputs] == [["bh", "spitze"], ["bh", "spitze"], [], []]
    assert values(spark, ["bh spitze"], lambda c: text.tokenize(c, 3)) == [["spitze"]]


def test_operators_and_markup(spark):
    inputs = ["bh +", '"push up"', "bh @2"]
    assert values(spark, inputs, text.strip_operators) == [text.operators_stripped(x) for x in inputs] == ["bh  ", " push up ", "bh  2"]
    assert values(spark, ["<p>a<b>b</b></p>c &amp; d"], text.strip_markup) == ["abc &amp; d"]


CODES = {
    "mueller": "657", "meyer": "67", "mayr": "67", "wikipedia": "3412", "rot": "72", "breit": "172", "aal": "05", "phon": "36", "ahl": "05", "tz": "8", "tr": "27",
    "ca": "4", "ce": "8", "aca": "04", "ace": "08", "sch": "8", "ax": "048", "kx": "48", "": "", "rot38": "72", "38": "",
}


def test_phonetics(spark):
    assert {k: phonetics.encoded(k) for k in CODES} == CODES
    assert values(spark, CODES, phonetics.encode) == list(CODES.values())


def test_distance(spark):
    pairs = [("rot", "rat", 1), ("nachtemd", "nachthemd", 1), ("spitzen", "spitze", 1), ("spitze", "splitz", 2), ("ab", "ba", 1), ("spitze", "sptize", 1), ("", "bh1", 3), ("ca", "abc", 3)]
    assert [distance.osa(a, b) for a, b, _ in pairs] == [d for *_, d in pairs]
    assert distance.osa("a", "abcdef", 2) == 3 and distance.osa("rot", "rock", 2) == 2
    assert [distance.budget_of(n) for n in (0, 3, 4, 6, 7, 40)] == [0, 0, 1, 1, 2, 2]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(distance.osa_within("a", "b", F.lit(2)).alias("d"), distance.may_be_within(F.col("a"), F.col("b"), 2).alias("m")).collect()
    assert [r.d for r in rows] == [min(3, d) for *_, d in pairs] and all(r.m for r, (*_, d) in zip(rows, pairs, strict=True) if d <= 2)


def test_early_exit_never_changes_a_distance_within_the_budget():
    import itertools

    words = ["".join(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a in words:
        for b in words:
            whole = distance.osa(a, b)
            assert distance.osa(a, b, 1) == min(whole, 2) and distance.osa(a, b, 2) == min(whole, 3)


FAMILIES = {
    "#000000": "schwarz", "#FFFFFF": "weiss", "#808080": "grau", "#FF0000": "rot", "#00FF00": "gruen", "#0000FF": "blau", "#FFC0CB": "rosa", "#8B4513": "braun", "#FFFDD0": "beige",
    "#FFF8DC": "beige", "#008080": "blau", "#808000": "gelb", "#D2B48C": "braun", "#E6E6FA": "weiss", "#f00": "rot", "ff0000cc": "rot", "": None, "#ff": None, "#gggggg": None, "schwarz": None, "#ff00": None,
}


def test_colors(spark):
    assert values(spark, FAMILIES, color.classify) == list(FAMILIES.values())
    parsed = values(spark, ["Schwarz_#272727", "Schwarz_Meliert_#272727", "Rot_#f00", "Rot_#ff0000cc", "Schwarz_272727", "Schwarz_#ff", "Schwarz_#ff0000ccdd", "Schwarz_#272727_matt"], color.parse)
    assert [tuple(p) for p in parsed[:4]] == [("Schwarz", "#272727"), ("Schwarz_Meliert", "#272727"), ("Rot", "#f00"), ("Rot", "#ff0000cc")]
    assert all(p["hex"] is None for p in parsed[4:])
    assert values(spark, ["Hellrot_#FF0000", "Rot", "x_#ff"], color.group) == ["Rot_#D32F2F", None, None]


def test_keys(spark):
    assert values(spark, ["Rot_#D32F2F", "Tomatencreme"], keys.value_id) == values(spark, ["rot d32f2f", "tomatencreme"], F.md5)
    dates = values(spark, ["2024-01-05", " 2024-01-05 ", "0000-00-00", "0000-00-00 00:00:00", "", None, "no date"], keys.insert_date)
    assert [d and d.date() for d in dates] == [date(2024, 1, 5)] * 2 + [None] * 5
    packed = values(spark, ["a\x1fLabel", "a"], keys.unpacked_value)
    assert [tuple(p) for p in packed] == [("a", "Label"), ("a", "a")]


@pytest.mark.parametrize("term", ["spitze", "bügel bh", "36c", "3/4", "s/m", "ART-12345", "a.b. mode", "70% baumwolle", "rock & bluse", "men's", ""])
def test_terms(spark, term):
    assert values(spark, [term], noise.reason) == [None]


def test_noise(spark):
    wanted = {
        "a\x01b": "control", "x" * 81: "length", "<script>": "markup", "javascript:alert": "markup", "x onerror = y": "markup", "&#x41;": "markup", "1 union all select 2": "sql", "select a from b": "sql",
        "'; drop table x": "sql", "sleep(5)": "sql", "' or 1=1": "sql", "admin' --": "sql", "../../x": "path", "/etc/passwd": "path", "php://input": "path", "{{7*7}}": "template", "${x}": "template",
        "$(id)": "shell", "`id`": "shell", "a;wget b": "shell", "see https://a.b": "url", "www.shop.de": "url", "!!!???***((())": "symbols",
    }
    assert values(spark, wanted, noise.reason) == list(wanted.values())


def test_periods():
    today = date(2026, 8, 31)
    assert periods.named("day", today).series_start == date(2026, 8, 18)
    month = periods.named("anything", today)
    assert (month.start, month.end, month.monthly) == (date(2026, 8, 1), today, False)
    assert periods.named("month", date(2026, 2, 3)).end.day == 28 and periods.named("month", date(2024, 2, 3)).end.day == 29
    assert periods.last_days(7, today).start == date(2026, 8, 25)
    assert not periods.last_days(62, today).monthly and periods.last_days(63, today).monthly
    assert periods.last_days(0, today).start == periods.last_days(-5, today).start == today
