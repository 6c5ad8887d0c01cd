"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues) in one
pass; at each anchor a small deterministic parser expands to the left and right and validates.

Nulls count as empty texts and give no spans; repeated rows are judged each on its own; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
import string

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import id_text, per_document, read

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the method adds to the base kinds: credentials in addresses, account numbers, named secrets.
ADDED_KINDS = ("login", "iban", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}

IBAN_CUES = ("IBAN", "Iban", "iban")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+(?=@)")
IBAN = re.compile(r"[:\s]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of a country's account numbers, by the IBAN registry.
IBAN_LENGTHS = {
    int(n): frozenset(names.split())
    for n, names in (x.split(":") for x in (
        "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH CR HR LI LV",
        "22:BG BH DE GB GE IE ME RS", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR",
        "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV", "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
    ))
}
IBAN_LENGTH = {name: n for n, names in IBAN_LENGTHS.items() for name in names}
SECRET = re.compile(r"[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_+/=.-]{8,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(number: str) -> bool:
    n = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the account number at `start` ends, -1 without one; text[start:end] is the longest run of its characters.
    It has its country's length; a country without one has no account numbers."""
    places = [i for i in range(start, end) if text[i] != " "]
    length = IBAN_LENGTH.get(text[start : start + 2], len(places) + 1)
    return places[length - 1] + 1 if len(places) >= length and iban_ok(text[start : places[length - 1] + 1]) else -1


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in string.digits:
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for form in IBAN_CUES:
        found.add_word(form, ("iban", 4))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(cue)))
    found.make_automaton()
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind), by start, then kind. Linear in the text: each parser goes on
    from where its last match ended, and a match that fails its check is consumed too."""
    out: list[tuple[int, int, str]] = []
    email_at = ip_at = card_at = phone_at = run_end = secret_at = 0
    for last, (kind, width) in automaton.iter(text):
        i = last - width + 1
        if kind == "digit":
            if i < run_end:
                continue
            run_end = DIGITS.match(text, i).end()
            if i >= ip_at and (m := IP.match(text, i)):
                ip_at = m.end()
                if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
                    out.append((i, ip_at, "ip"))
            if i >= card_at and (m := CARD.match(text, i)):
                card_at = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((i, card_at, "card"))
        elif kind == "at":
            start = i
            while start > email_at and text[start - 1] in LOCAL:
                start -= 1
            if start < i and (m := DOMAIN.match(text, i + 1)):
                email_at = m.end()
                out.append((start, email_at, "email"))
        elif kind == "plus":
            if i >= phone_at and (m := PHONE.match(text, i)):
                phone_at = m.end()
                if 9 <= sum(c in string.digits for c in m[0]) <= 15:
                    out.append((i, phone_at, "phone"))
        elif kind == "scheme":
            if m := LOGIN.match(text, last + 1):
                out.append((m.start(), m.end(), "login"))
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and (end := iban_end(text, m.start(1), m.end(1))) > 0:
                out.append((m.start(1), end, "iban"))
        elif i >= secret_at and (m := SECRET.match(text, last + 1)):
            secret_at = m.end()
            if any(c in string.digits for c in m[1]):
                out.append((m.start(1), m.end(1), "secret"))
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of start, end, kind), text with the spans replaced."""

    def make():
        automaton = anchors()

        def work(ids, texts):
            texts = [t or "" for t in texts]
            found = [find(t, automaton) for t in texts]
            return ids, [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]

        return work

    return per_document(id_text(docs, id_col, text_col), make, "doc_id long, spans array<struct<start:long,end:long,kind:string>>, redacted string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    text = lambda spans: F.array_join(F.transform(spans, one), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sql5() -> str:
    """Matches by kind from pieces between matches; offsets add up the lengths before each."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "login": r"://[^\s/@:?#]+:[^\s/@?#]+@",
        "secret": "(?:" + "|".join(f for c in SECRET_CUES for f in (c, c.upper(), c.capitalize())) + r""")[ \t]*[=:][ \t]*["']?[A-Za-z0-9_+/=.-]{8,}""",
    }
    inner = {
        "login": ("3", "length(m) - 4"),
        "secret": (r"""length(regexp_extract(m, '^[A-Za-z_]+[ \t]*[=:][ \t]*["'']?'))""", r"""length(m) - length(regexp_extract(m, '^[A-Za-z_]+[ \t]*[=:][ \t]*["'']?'))"""),
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
    fine = {
        "email": "true", "login": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "secret": "regexp_matches(substr(m, skip::BIGINT + 1), '[0-9]')",
    }
    parts = []
    for k, pattern in patterns.items():
        p = pattern.replace("'", "''")
        skip, width = inner.get(k, ("0", "length(m)"))
        parts.append(f"""SELECT rid, '{k}' AS kind, {ORDER[k]} AS o, before + skip AS a, before + skip + width AS b FROM (
  SELECT rid, m, {skip} AS skip, {width} AS width, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS before
  FROM (SELECT rid, ms, pieces, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS pieces FROM d) WHERE len(ms) > 0)) WHERE {fine[k]}""")
    # a cue at a time, as the run of one may reach over the next; the number has its country's length and passes mod 97
    lengths = "CASE substr(c, 1, 2) " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in sorted(IBAN_LENGTH.items())) + " END"
    number = "list_reduce(list_transform(string_split(list_aggregate(list_transform(string_split(n[5:] || n[:4], ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), 'string_agg', ''), ''), lambda c: c::INT), lambda a, b: (a * 10 + b) % 97)"
    parts.append(rf"""SELECT rid, 'iban' AS kind, {ORDER["iban"]} AS o, place + skip AS a, place + skip + list_filter(generate_series(1, length(c)), lambda i: length(replace(c[1:i], ' ', '')) = size)[1] AS b FROM (
  SELECT *, replace(c, ' ', '')[1:size] AS n FROM (SELECT *, {lengths} AS size FROM (
  SELECT rid, place, length(regexp_extract(after, '^[:\s]{{0,3}}')) AS skip, regexp_extract(after, '^[:\s]{{0,3}}([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})', 1) AS c FROM (
  SELECT rid, place, substr(text, place + 1, 80) AS after FROM (
  SELECT rid, text, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + 4 * i)::BIGINT AS place FROM (
  SELECT rid, text, pieces, unnest(generate_series(1, len(pieces) - 1)) AS i FROM (SELECT rid, text, string_split_regex(text, '{"|".join(IBAN_CUES)}') AS pieces FROM d) WHERE len(pieces) > 1)))) WHERE c <> '')
  WHERE length(replace(c, ' ', '')) >= size) WHERE {number} = 1""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)},
  string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, o) FILTER (WHERE kind IN ({base})) AS base, string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, o) AS spans FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; all columns stay, n_chars follows the new text."""
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        automaton = anchors()
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [None if t is None else redact(t, find(t, automaton)) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out
