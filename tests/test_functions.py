import pytest
from pyspark.sql import functions as F

from lodestream.functions import dates, jsons, numbers, strings


@pytest.fixture()
def value(spark):
    one = spark.range(1)

    def run(column, **columns):
        df = one
        for name, v in columns.items():
            df = df.withColumn(name, v if not isinstance(v, (str, int, float)) and v is not None else F.lit(v))
        return df.select(column.alias("v")).first()["v"]

    return run


def test_dates(value):
    n = F.lit(20230829)
    assert value(dates.add_days(n, F.lit(5))) == 20230903
    assert value(dates.add_months(n, F.lit(2))) == 20231029
    assert value(dates.add_months(F.lit(20230131), F.lit(1))) == 20230228
    assert value(dates.add_years(n, F.lit(1))) == 20240829 and value(dates.add_years(F.lit(20240229), F.lit(1))) == 20250229
    assert value(dates.add_days(F.lit(0), F.lit(5))) == 0
    assert value(dates.days_between(n, F.lit(20230824))) == 5
    assert value(dates.day_of_week(n)) == 2 and value(dates.day_name(n)) == "Tuesday" and value(dates.month_name(n)) == "August"
    assert value(dates.day_of_week(F.lit(0))) == -1
    assert value(dates.julian(F.lit(10101))) == 1 and value(dates.calendar(dates.julian(n))) == 20230829 and value(dates.calendar(F.lit(0))) == 0
    assert value(dates.format_date(n, dates.LONG)) == "Aug 29, 2023" and value(dates.format_date(F.lit(0), dates.ISO)) == ""
    assert value(dates.compose(F.lit(23), F.lit(8), F.lit(29))) == 20230829 and value(dates.compose(F.lit(99), F.lit(1), F.lit(2))) == 19990102 and value(dates.compose(F.lit(2023), F.lit(0), F.lit(1))) == 0


@pytest.mark.parametrize(("text", "number"), [("08/29/2023", 20230829), ("2023-8-9", 20230809), ("8.29.23", 20230829), ("2/30/2023", 0), ("x", 0), ("", 0), (None, 0)])
def test_parse_date(value, text, number):
    assert value(dates.parse_date(F.lit(text).cast("string"))) == number


@pytest.mark.parametrize(("long", "number"), [(202308291430, 20230829), (20230829, 20230829), (1693319400, 20230829), (1693319400000, 20230829), (1234, 19700101)])
def test_date_of_a_long(value, long, number):
    assert value(dates.from_number(F.lit(long))) == number


@pytest.mark.parametrize(
    ("text", "time"),
    [("330", 330), ("03:30", 330), ("805", 805), ("2:30 PM", 1430), ("2:30pm", 1430), ("230 PM", 1430), ("2:30 AM", 230), ("12:00 AM", 0), ("12:00 PM", 1200), ("2134", 2134), ("8a", 800), ("8p", 2000), ("8", 800), ("330p", 1530), ("12345", -1), ("abc", -1), ("", -1)],
)
def test_parse_time(value, text, time):
    assert value(dates.parse_time(F.lit(text))) == time


def test_times(value):
    assert [value(dates.military(F.lit(t))) for t in (1430, 305, 2359)] == ["14:30", "03:05", "23:59"]
    assert [value(dates.am_pm(F.lit(t))) for t in (1430, 305, 2359, 0, 1230)] == ["2:30 PM", "3:05 AM", "11:59 PM", "12:00 AM", "12:30 PM"]
    assert value(dates.hour(F.lit(1430))) == 14 and value(dates.minutes(F.lit(1430))) == 30


def test_date_times(value):
    n = F.lit(202401311430).cast("long")
    zero = {k: F.lit(0) for k in ("years", "months", "days", "hours", "mins")}
    assert value(dates.plus(n, **zero | {"months": F.lit(1)})) == 202402291430
    assert value(dates.plus(n, **zero | {"hours": F.lit(10)})) == 202402010030
    assert value(dates.create(F.lit(20240131), F.lit(1430))) == 202401311430
    assert value(dates.from_epoch(dates.to_epoch(n, "America/New_York"), "America/New_York")) == 202401311430
    assert value(dates.minutes_between(F.lit(202403100400), F.lit(202403100100), "America/New_York")) == 120
    assert value(dates.format_stamp(n)) == "01/31/2024 2:30 PM" and value(dates.format_stamp(F.lit(0))) == ""
    assert value(dates.date_part(n)) == 20240131 and value(dates.time_part(n)) == 1430


def test_strings(value):
    s = lambda text: F.lit(text)
    assert value(strings.take(s("Hel"), 5)) == "Hel  " and value(strings.take(s("Hi"), -4)) == "  Hi" and value(strings.take(s("Hello"), -2)) == "lo"
    assert value(strings.drop(s("Hello"), -2)) == "Hel" and value(strings.drop(s("Hello"), 2)) == "llo" and value(strings.drop(s("Hi"), 5)) == "" == value(strings.drop(s("Hi"), -5))
    assert value(strings.strip(s(" \t x \n"))) == "x" and value(strings.right_strip(s("x \t"))) == "x" and value(strings.left_strip(s(" \tx"))) == "x"
    assert value(strings.join(F.array(s(""), s("a"), s(""), s("b")), ",")) == "a,,b"
    assert value(strings.split(s("a,b,,"), ",")) == ["a", "b"] and value(strings.split(s(""), ",")) == [] and value(strings.split(s(",a"), ",")) == ["", "a"]
    assert value(strings.html_to_text(s("Hello<br>World"))) == "Hello\nWorld" and value(strings.html_to_text(s("<b>Test</b>"))) == " Test " and value(strings.html_to_text(s("“a” &lt;b&gt; &amp;amp;"))) == '"a" <b> &amp;'
    assert value(strings.to_ascii(s("áéíóú"))) == "aeiou" and value(strings.to_ascii(s("© ®"))) == "(c) (r)" and value(strings.to_ascii(s("ßÅ中ñ"))) == "ssAn"
    assert value(strings.closest_match(s("grap"), ["apple", "banana", "grape"])) == "grape"
    assert value(strings.first_char(s(""))) is None and value(strings.is_empty(s("")))


def test_similarity():
    assert strings.similarity("martha", "marhta") == pytest.approx(0.9611, abs=1e-3)
    assert strings.similarity("a", "a") == 1 and strings.similarity("abc", "xyz") == 0


def test_codecs(value):
    assert value(strings.base64_encode(F.lit("x" * 100).cast("binary"))).count("\n") == 0
    assert value(strings.decrypt(strings.encrypt(F.lit("secret"), "pw"), "pw")) == "secret"
    assert value(strings.might_be_base64(F.lit("YWJj"))) and not value(strings.might_be_base64(F.lit("a b")))
    assert value(strings.url_with("http://x", {"a": F.lit("1 2"), "b": F.lit("&")})) == "http://x?a=1+2&b=%26"
    assert value(strings.xml_unescape(strings.xml_escape(F.lit("<a b='c'>&amp;")))) == "<a b='c'>&amp;"


def test_numbers(value):
    n = F.lit(123.456)
    assert [value(f(n, 2)) for f in (numbers.round_half_up, numbers.round_up, numbers.round_down)] == [123.46, 123.46, 123.45]
    assert value(numbers.floor(F.lit(-123.456))) == -124 and value(numbers.round_half_up(F.lit(-2.5), 0)) == -3
    assert value(numbers.parse_double(F.lit("488,678.98"))) == 488678.98 and value(numbers.parse_long(F.lit("488,678.98"))) == 488678 and value(numbers.parse_int(F.lit("abc"))) == 0
    assert value(numbers.is_number(F.lit("1,234.5"))) and not value(numbers.is_number(F.lit("1.2.3"))) and not value(numbers.is_number(F.lit("-1")))
    assert value(numbers.near(F.lit(1.0), F.lit(1.001), 0.01))


@pytest.mark.parametrize(
    ("args", "text"),
    [((12345.146, "C", 10, 2), " 12,345.15"), ((125.146, "CL", 10, 2), "125.15    "), ((1236354545.146, "C", 0, 2), "1,236,354,545.15"), ((-5.146, "ZP", 10, 2), "(00005.15)"), ((0, "CB", -1, -1), " "), ((5.146, "CD", 10, 2), "     $5.15"), ((255, "U", 0, 0, 16), "FF"), ((123456, "", 4, 0), "****"), ((123456, "C", 6, 0), "123456"), ((-1.5, "", 0, 1), "-1.5")],
)
def test_pictures(args, text):
    assert numbers.picture(*args) == text


PERSON = '{"name": "Ann", "age": 41, "salary": 10.5, "married": true, "children": [{"name": "Bo", "age": 5}], "initial": "A", "birthday": "08/29/1982", "a/b": 1, "m~n": 2}'


def test_json(value):
    p = F.lit(PERSON)
    assert value(jsons.get_string(p, "name")) == "Ann" and value(jsons.get_int(p, "children[0].age")) == 5 and value(jsons.get_double(p, "salary")) == 10.5
    assert value(jsons.get_boolean(p, "married")) is True and value(jsons.get_date(p, "birthday")) == 19820829 and value(jsons.get_char(p, "initial")) == "A"
    assert value(jsons.get_string(p, "children[7].age")) is None and value(jsons.get_int(p, "name")) is None and value(jsons.get_string(F.lit("{bad"), "a")) is None
    assert value(jsons.query(p, "/children/0/name")) == "Bo" and value(jsons.query(p, "/a~1b", "int")) == 1 and value(jsons.query(p, "#/m~0n", "int")) == 2
    assert jsons.pointer_tokens(jsons.pointer_of(["a/b", "c~d", ""], True)) == ["a/b", "c~d", ""]
    assert value(jsons.fill(F.lit("Hi ${NAME}, ${OTHER}"), {"NAME": F.lit("x")})) == "Hi x, ${OTHER}"
    assert value(jsons.has_key(p, "age")) and not value(jsons.has_key(p, "none"))
    with pytest.raises(ValueError):
        jsons.json_path("a..b")
    with pytest.raises(ValueError):
        jsons.pointer_tokens("a")
