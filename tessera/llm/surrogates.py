"""PII surrogates by DataFrame and SQL functions alone.

Entities are found by one regular expression and told apart by form: e-mail,
phone, IPv4 address, social security number, card number, IBAN, and names
behind a title. Each distinct entity gets a surrogate from a keyed SHA-512
that keeps its type: digits for digits and letters for letters, country code,
issuer digit, Luhn check, private address ranges, top-level domain, and for
names the title's gender, the script, the number of words and their case. The
same entity, however written, gets the same surrogate in every document;
surrogates that meet one another or an original are hashed again until all
entities of a type have different ones.

Defined cases. Null text stays null, with no entities. Whole texts are read.
Repeated rows get equal results; a null doc_id passes through. Text outside of
entities stays as it is, so documents without any are returned unchanged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, content_key, passing

#: The key of the registered query, which is public as its results are; a real run has a secret one.
QUERY_KEY = "tessera-surrogates-1"
#: From this attempt on surrogates are of a wider form, as the entity's own form may have too few.
WIDER, ROUNDS = 4, 60
ENTITIES_A_TASK = 1000

#: Titles that tell a name and a gender.
MALE = "Mr|Herr|Señor|Sr|Monsieur|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа"

_WORD = r"\p{Lu}[\p{L}'’-]+"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
NAME = rf"(?<![\p{{L}}-])(?:{MALE}|{FEMALE})\.? {_WORD}(?: {_WORD})?"
ENTITY = "|".join([EMAIL, PHONE, IP, SSN, CARD, IBAN, NAME])
#: A quick look that every text with an entity passes.
HINT = rf"[0-9@]|(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

#: Given names by gender and script, and syllables of made-up family names by script.
GIVEN = {
    "m_latin": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Luis Marc Nils Oscar Paul Rene Simon Tomas Viktor".split(),
    "f_latin": "Alma Berta Clara Diana Elsa Flora Greta Helena Irma Julia Karla Lena Maria Nora Olga Petra Rosa Sofia Teresa Vera".split(),
    "m_cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    "f_cyrillic": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo wa zo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа хо ша".split(),
}


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def kind_of(m: str) -> str:
    """SQL: the type of the entity in column m."""
    return f"""CASE WHEN contains({m}, '@') THEN 'email'
      WHEN {m} RLIKE r'^[(+]' OR {m} RLIKE r'^[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$' THEN 'phone'
      WHEN {m} RLIKE r'^[0-9]+([.][0-9]+){{3}}$' THEN 'ip'
      WHEN {m} RLIKE r'^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
      WHEN {m} RLIKE r'^[0-9 -]+$' THEN 'card'
      WHEN {m} RLIKE r'^[A-Z]{{2}}[0-9]{{2}}' THEN 'iban'
      WHEN {m} RLIKE r'^({FEMALE})[.]? ' THEN 'name_f' ELSE 'name_m' END"""


def canon_of(m: str, kind: str) -> str:
    """SQL: one spelling for all ways to write the entity."""
    return f"""CASE WHEN {kind} = 'email' THEN lower({m})
      WHEN {kind} IN ('phone', 'card', 'ssn') THEN regexp_replace({m}, '[^0-9]', '')
      WHEN {kind} LIKE 'name%' THEN lower(regexp_replace({m}, r'^[^ ]+ ', '')) ELSE {m} END"""


def byte_at(i: str) -> str:
    """SQL: a number from 0 to 255 of the hash in column h."""
    return f"cast(conv(substr(h, cast(2 * pmod({i}, 63) + 1 as int), 2), 16, 10) as int)"


def in_kind(chars: str, keep: str = "0") -> str:
    """SQL: letters for letters and digits for digits of the text, but for its first `keep` characters."""
    letter = f"substr('abcdefghijklmnopqrstuvwxyz', {byte_at('i')} % 26 + 1, 1)"
    return f"""array_join(transform(split({chars}, ''), (c, i) -> CASE WHEN i < {keep} THEN c
      WHEN c RLIKE '[0-9]' THEN cast({byte_at('i')} % 10 as string) WHEN c RLIKE '[a-z]' THEN {letter}
      WHEN c RLIKE '[A-Z]' THEN upper({letter}) ELSE c END), '')"""


def luhn(digits: str) -> str:
    """SQL: the check digit to come behind the digits."""
    d = f"cast(substr({digits}, i, 1) as int)"
    twice = f"(CASE WHEN (length({digits}) - i) % 2 = 0 THEN {d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)"
    return f"cast(pmod(10 - aggregate(sequence(1, length({digits})), 0, (acc, i) -> acc + {twice}) % 10, 10) as string)"


def _family(script: str) -> str:
    s = _quoted(SYLLABLES[script])
    n = len(SYLLABLES[script])
    more = f"CASE WHEN attempt >= {WIDER} THEN concat({s}[{byte_at('11')} % {n}], {s}[{byte_at('12')} % {n}], {s}[{byte_at('13')} % {n}]) ELSE '' END"
    return f"initcap(concat({s}[{byte_at('7')} % {n}], {s}[{byte_at('8')} % {n}], {s}[{byte_at('9')} % {n}], {s}[{byte_at('10')} % {n}], {more}))"


def _given(gender: str, script: str) -> str:
    names = GIVEN[f"{gender}_{script}"]
    return f"{_quoted(names)}[{byte_at('3')} % {len(names)}]"


def surrogate_of() -> str:
    """SQL over kind, canon and the hash h."""

    def name(gender: str) -> str:
        by_script = {s: f"CASE WHEN contains(canon, ' ') THEN concat({_given(gender, s)}, ' ', {_family(s)}) ELSE {_family(s)} END" for s in SYLLABLES}
        return f"CASE WHEN canon RLIKE r'\\p{{IsCyrillic}}' THEN {by_script['cyrillic']} ELSE {by_script['latin']} END"

    body = in_kind("left(canon, length(canon) - 1)", "1")
    octet = f"""CASE WHEN canon LIKE '192.168.%' AND attempt >= {WIDER} THEN CASE WHEN i = 0 THEN '10' ELSE cast({byte_at('i')} % 254 + 1 as string) END
      WHEN i = 0 AND (o IN ('10', '127') OR canon LIKE '192.168.%') THEN o
      WHEN i = 1 AND canon LIKE '192.168.%' THEN o ELSE cast({byte_at('i')} % 254 + 1 as string) END"""
    return f"""CASE kind
      WHEN 'email' THEN concat({in_kind("substring_index(canon, '@', 1)")}, CASE WHEN attempt >= {WIDER} THEN substr(h, 101, 12) ELSE '' END, '@', {in_kind("substring_index(substring_index(canon, '@', -1), '.', 1)", "0").replace(byte_at('i'), byte_at('i + 29'))}, '.example.', substring_index(canon, '.', -1))
      WHEN 'phone' THEN {in_kind('canon', '1')}
      WHEN 'ssn' THEN {in_kind('canon')}
      WHEN 'card' THEN concat({body}, {luhn('(' + body + ')')})
      WHEN 'iban' THEN {in_kind('canon', '2')}
      WHEN 'ip' THEN array_join(transform(split(canon, '[.]'), (o, i) -> {octet}), '.')
      WHEN 'name_f' THEN {name('f')} ELSE {name('m')} END"""


def worn(m: str, kind: str, s: str) -> str:
    """SQL: the surrogate s as the entity m was written."""
    nth = f"length(regexp_replace(substr({m}, 1, i + 1), '[^0-9]', ''))"
    digits = f"array_join(transform(split({m}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN substr({s}, {nth}, 1) ELSE c END), '')"
    plain = f"regexp_replace({m}, r'^[^ ]+ ', '')"
    return f"""CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN {digits}
      WHEN {kind} = 'email' THEN CASE WHEN {m} = upper({m}) AND {m} <> lower({m}) THEN upper({s}) ELSE {s} END
      WHEN {kind} LIKE 'name%' THEN concat(regexp_extract({m}, r'^[^ ]+ ', 0), CASE WHEN {plain} = upper({plain}) THEN upper({s}) ELSE {s} END)
      ELSE {s} END"""


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 of the message, in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def entity_surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, canon, surrogate: distinct surrogates for the distinct entities, none of them an entity itself."""
    now = scratch.table(entities.distinct().withColumn("attempt", F.lit(0)), "entities0")
    tasks = max(1, -(-now.count() // ENTITIES_A_TASK))
    for n in range(1, ROUNDS + 1):
        # A small table is one file, but making surrogates takes its time.
        hashed = now.repartition(tasks).withColumn("h", hmac(key, F.concat_ws("|", "kind", "canon", F.col("attempt").cast("string"))))
        made = hashed.withColumn("surrogate", F.expr(surrogate_of())).drop("h")
        met = made.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        originals = now.select(F.col("kind"), F.when(F.col("kind").startswith("name"), F.initcap("canon")).otherwise(F.col("canon")).alias("surrogate"), F.lit(True).alias("taken"))
        rated = made.join(met, ["kind", "surrogate"]).join(originals.distinct(), ["kind", "surrogate"], "left")
        bad = F.coalesce("taken", F.lit(False)) | (F.col("first.canon") != F.col("canon"))
        now = scratch.table(rated.select("kind", "canon", "surrogate", F.when(bad, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), bad.alias("bad")), f"entities{n}")
        if not now.where("bad").head(1):
            return now.select("kind", "canon", "surrogate")
        now = now.select("kind", "canon", "attempt")
    raise RuntimeError("a type has too few surrogates for its entities")


def text_key(text: Column | str = "text") -> list[Column]:
    return content_key(text)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with entities replaced in text, and n_entities and kinds (how many of each type, by name), in the place of columns of these names."""
    return passing(docs.drop("n_entities", "kinds"), ("text",), lambda d: _with_surrogates(d, key))


def _with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        texts = docs.select(*text_key(), "text").where(F.col("text").rlike(HINT))
        found = texts.select("__k1", "__k2", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)).alias("found")).where("size(found) > 0")
        # Copies of a text are one from here on.
        found = scratch.table(found.groupBy("__k1", "__k2").agg(F.first("found").alias("found")), "found")
        each = found.select("__k1", "__k2", F.posexplode("found").alias("pos", "m"))
        each = each.withColumn("kind", F.expr(kind_of("m"))).withColumn("canon", F.expr(canon_of("m", "kind")))
        known = entity_surrogates(each.select("kind", "canon"), scratch, key)
        put = each.join(known, ["kind", "canon"]).select("__k1", "__k2", "pos", "kind", F.expr(worn("m", "kind", "surrogate")).alias("s"))
        per = put.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(F.struct("pos", "s", "kind"))).alias("put"))
        per = scratch.table(per.select("__k1", "__k2", F.col("put.s").alias("__put"), F.col("put.kind").alias("__kinds")), "put", keep=True)
    names = docs.columns
    joined = docs.select("*", *text_key()).join(per.hint("shuffle_hash"), ["__k1", "__k2"], "left")
    between = F.split("text", ENTITY, -1)
    filled = F.concat_ws("", F.zip_with(between, F.col("__put"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    kinds = F.transform(F.array_sort(F.array_distinct("__kinds")), lambda k: F.concat_ws(":", k, F.size(F.filter("__kinds", lambda x: x == k))))
    own = {"text": F.when(F.col("__put").isNull(), F.col("text")).otherwise(filled)}
    return joined.select(
        *[own.get(c, F.col(f"`{c}`")).alias(c) for c in names],
        F.coalesce(F.size("__put"), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("kinds"),
    )


def surrogate_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_entities, kinds, and the text with surrogates."""
    out = with_surrogates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), QUERY_KEY)
    return out.select("doc_id", "n_entities", "kinds", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
