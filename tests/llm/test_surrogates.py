import hashlib
import hmac as plain_hmac
import re

from pyspark.sql import functions as F

from tessera.llm.surrogates import hmac, surrogate_digest, with_surrogates

ROWS = [
    (1, "Mail a.b1@mail3.example.com or A.B1@MAIL3.EXAMPLE.COM; +1 (523) 555-7040, card 4111 1111 1111 1111 and 4111111111111111"),
    (2, "again a.b1@mail3.example.com and 10.1.2.3, 8.8.4.4. Mr. John Smith met Frau Müller, Mr JOHN SMITH"),
    (3, None), (4, ""), (5, "clean text, version 2.0 of 1999 with token = \"99b1a99c12345678901234\" only"), (None, "ssn 123-45-6789"), (6, "x " * 60_000 + "8.8.4.4"), (2, "again a.b1@mail3.example.com and 10.1.2.3, 8.8.4.4. Mr. John Smith met Frau Müller, Mr JOHN SMITH"),
    (7, "г-жа Иванова и г-н Петров"),
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def test_surrogates_keep_type_coreference_and_the_rest(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, found string")
    out = with_surrogates(df, "a key")
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and out.columns == ["doc_id", "text", "found", "n_entities", "kinds"]
    assert got[3].text is None and got[4].text == "" and got[5].text == ROWS[4][1] and got[5].n_entities == 0
    mail = re.findall(r"\S+@\S+?(?=[; ]|$)", got[1].text)
    assert mail[0].lower() == mail[1].lower() != "a.b1@mail3.example.com" and mail[1].isupper() and mail[0] in got[2].text
    cards = re.findall(r"4[\d ]{15,18}\d|4\d{15}", got[1].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and luhn(cards[1]) and cards[0].count(" ") == 3
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and "523) 555-7040" not in got[1].text
    assert re.search(r"and 10\.\d+\.\d+\.\d+,", got[2].text) and "8.8.4.4" not in got[2].text + got[6].text
    name = re.search(r"Mr\. (\w+ \w+) met Frau (\w+), Mr (\w+ \w+)", got[2].text)
    assert name[1].upper() == name[3] and "Smith" not in got[2].text and "Müller" not in got[2].text
    assert re.fullmatch(r"г-жа [А-я]+ и г-н [А-я]+", got[7].text) and "Иванова" not in got[7].text
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", got[None].text) and "123-45-6789" not in got[None].text
    assert got[1].kinds == "card:2,email:2,phone:1"


def test_distinct_entities_stay_distinct(spark):
    rows = [(i, f"a.{i % 10}{j}@m.example.com 5.5.{i}.{j}") for i in range(40) for j in range(5)]
    out = surrogate_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mails = {r.text.split()[0] for r in out}
    assert len(mails) == 50 and len({r.text.split()[1] for r in out}) == 200
    assert not mails & {t.split()[0] for _, t in rows}


def test_hmac_is_the_standard_one(spark):
    for key in ("k", "long " * 50):
        got = spark.range(1).select(hmac(key, F.lit("name|josé|0")).alias("h")).first().h
        assert got == plain_hmac.new(key.encode(), "name|josé|0".encode(), hashlib.sha512).hexdigest()


def test_a_form_with_too_few_surrogates_is_widened(spark):
    # 520 of the 676 two-letter mailboxes at hosts of no own letters, and 40,000 of the 64,516 private addresses.
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{a}{b}@1.de") for i, (a, b) in enumerate((a, b) for a in letters[:20] for b in letters)]
    rows += [(10_000 + i, " ".join(f"192.168.{i}.{j}" for j in range(1, 251))) for i in range(1, 161)]
    out = surrogate_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    made = [x for r in out for x in r.text.split()]
    assert len(made) == len(set(made)) == 520 + 40_000 and not set(made) & {x for _, t in rows for x in t.split()}


def test_plan_is_native_and_empty_table(spark):
    out = surrogate_digest(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
