"""Personal data in texts, with DataFrame functions only: patterns propose spans, checks confirm them, words nearby adjust their score.

Every pattern is read twice: its matches, and what stands between them. The lengths of both, summed up, are the places of the matches,
so the work is linear in the text; no text is moved.

Base kinds have a score over the threshold as soon as their check holds. Two kinds are added: bank account numbers (`iban`, mod 97), and
telephone numbers without a country code (`tel`), which need a word like "phone" within CONTEXT characters. A span has a score of 0 to 100:
what its kind is worth, and BONUS if one of the kind's words stands nearby.

Patterns are the plain ones of TERMS, written for an engine that goes back: no repetition that could be given back, and a look at the character
before, so that a long run is read once and not once for each of its characters. Where a run may begin after a span, \\G lets it.

Edge cases: a null text counts as empty and has no spans. Each row is searched by itself: repeated rows and null ids keep their results.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import table

CONTEXT, BONUS, THRESHOLD = 40, 30, 50


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_address(text: Column) -> Column:
    """Four numbers of at most 255, zeros before them or not."""
    number = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return text.rlike(rf"^{number}(?:\.{number}){{3}}$")


def is_card(text: Column) -> Column:
    d = digits(text)
    return F.char_length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_phone(text: Column) -> Column:
    return F.char_length(digits(text)).between(9, 15)


def mod97(text: Column) -> Column:
    """The remainder of the number that letters and digits stand for (A: 10, Z: 35)."""
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) < 65, 48).otherwise(55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def is_iban(text: Column) -> Column:
    bare = F.replace(text, F.lit(" "))
    return F.char_length(bare).between(15, 34) & (mod97(F.concat(F.substring(bare, 5, 34), F.substring(bare, 1, 4))) == 1)


def is_national(text: Column) -> Column:
    return text.rlike(r"^(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$")


class Kind(NamedTuple):
    name: str
    pattern: str
    holds: Callable[[Column], Column] | None
    worth: int
    words: str
    apart: bool = False  # no letter or digit may touch it
    needs: str = "[0-9]"  # in every match: texts without it aren't searched


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", None, 70, "mail|contact|write", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_address, 60, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", is_card, 60, "card|visa|credit|debit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 60, "phone|tel|call|mobil|fax|ruf"),
)
ADDED = (
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", is_iban, 50, "iban|bank|account|konto|compte|cuenta", apart=True),
    Kind("tel", r"(?:\G|(?<![+0-9]))(?:[+0-9]+[ .-]?)?\(?[0-9]{3}\)?[ .-]? ?[0-9]{3}[ .-][0-9]{4}[0-9]*", is_national, 20, "phone|tel|call|mobil|fax|ruf", apart=True),
)
#: The plain patterns that the ones above are equal to.
TERMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?",
    "tel": r"([+0-9]+[ .-]?)?\(?[0-9]{3}\)?[ .-]? ?[0-9]{3}[ .-][0-9]{4}[0-9]*",
}


def running_sum(numbers: Column) -> Column:
    """Sums of the first 1, 2, 3 .. numbers, in rounds that each add what stands 1, 2, 4 .. places before."""

    def add(sums: Column, step: Column) -> Column:
        return F.when(F.size(sums) > step, F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - step), F.lit(0).cast("long")))).otherwise(sums)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(31)]), numbers, add)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, spans (kind, start, end, score, value) of each row of docs: by kind in the order of `kinds`, then by start; code points, end exclusive."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    n, needs = range(len(kinds)), sorted({k.needs for k in kinds})
    rows = rows.select("doc_id", "text", *[F.col("text").rlike(x).alias(f"has{i}") for i, x in enumerate(needs)])
    matches = lambda k: F.when(F.col(f"has{needs.index(k.needs)}"), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(none)
    rows = rows.select("doc_id", "text", *[matches(k).alias(f"m{i}") for i, k in enumerate(kinds)])
    # one more than matches
    rows = rows.select("doc_id", *[f"m{i}" for i in n], *[F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none).alias(f"g{i}") for i, k in enumerate(kinds)])
    before = lambda i: F.slice(f"g{i}", F.lit(1), F.size(f"m{i}"))
    rows = rows.select(
        "doc_id", *[f"m{i}" for i in n],
        *[running_sum(F.zip_with(before(i), F.col(f"m{i}"), lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))).alias(f"e{i}") for i in n],
        *[F.transform(before(i), lambda g: F.right(g, F.lit(CONTEXT))).alias(f"b{i}") for i in n],
        *[F.transform(F.slice(f"g{i}", F.lit(2), F.size(f"m{i}")), lambda g: F.left(g, F.lit(CONTEXT))).alias(f"a{i}") for i in n],
    )

    def scored(i: int, k: Kind) -> Column:
        def one(z: Column) -> Column:
            value, b, a = z[f"m{i}"], z[f"b{i}"], z[f"a{i}"]
            holds = F.lit(True) if k.holds is None else k.holds(value)
            if k.apart:
                holds = holds & ~b.rlike("[A-Za-z0-9]$") & ~a.rlike("^[A-Za-z0-9]")
            near = F.lower(F.concat(b, F.lit(" "), a)).rlike(k.words)
            score = F.when(holds, k.worth + F.when(near, BONUS).otherwise(0)).otherwise(0)
            return F.struct(F.lit(k.name).alias("kind"), (z[f"e{i}"] - F.char_length(value)).alias("start"), z[f"e{i}"].alias("end"), score.alias("score"), value.alias("value"))

        return F.filter(F.transform(F.arrays_zip(f"m{i}", f"e{i}", f"b{i}", f"a{i}"), one), lambda s: s.score >= threshold)

    return rows.select("doc_id", F.concat(*[scored(i, k) for i, k in enumerate(kinds)]).alias("spans"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of each document."""
    found = spans(table(spark, sf_dir, "documents"))
    names = [k.name for k in BASE]
    as_text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda name: F.size(F.filter("spans", lambda x: x.kind == name)).cast("long")
    base = F.filter("spans", lambda x: x.kind.isin(names))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in names], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), *[of(k.name).alias(f"n_{k.name}") for k in ADDED])


def _sql() -> str:
    digits_ = "regexp_replace(v, '[^0-9]', '', 'g')"
    letter = lambda c: f"(ascii({c}) - case when ascii({c}) < 65 then 48 else 55 end)"
    holds = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(v, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 else cast('0' || ltrim(x, '0') as int) end)) <= 255",
        "card": f"""length({digits_}) between 13 and 19 and list_sum(list_transform(range(1, length({digits_}) + 1), lambda i: case when i % 2 = 1 then 1 when reverse({digits_})[i] >= '5' then 2 else 2 end
          * cast(reverse({digits_})[i] as int) - case when i % 2 = 0 and reverse({digits_})[i] >= '5' then 9 else 0 end)) % 10 = 0""",
        "phone": f"length({digits_}) between 9 and 15",
        "iban": f"""length(replace(v, ' ', '')) between 15 and 34 and list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: {letter("c")}),
          lambda rest, c: (rest * case when c > 9 then 100 else 10 end + c) % 97, 0) = 1""",
        "tel": r"regexp_full_match(v, '(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}')",
    }
    parts = []
    for i, k in enumerate(BASE + ADDED):
        p = TERMS[k.name]
        apart = " and not regexp_matches(b, '[A-Za-z0-9]$') and not regexp_matches(a, '^[A-Za-z0-9]')" if k.apart else ""
        parts.append(f"""select r, {i} as o, '{k.name}' as kind, v, e - length(v) as s, e from (select r, v, right(b, {CONTEXT}) as b, left(a, {CONTEXT}) as a, sum(length(b) + length(v)) over (partition by r order by i) as e
          from (select r, unnest(m) as v, unnest(g[1:len(m)]) as b, unnest(g[2:]) as a, generate_subscripts(m, 1) as i from (select r, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as g from d) where len(m) > 0))
          where case when {holds[k.name]}{apart} then {k.worth} + case when regexp_matches(lower(b || ' ' || a), '{k.words}') then {BONUS} else 0 end else 0 end >= {THRESHOLD}""")
    n = lambda k: f"cast(count(*) filter (where kind = '{k.name}') as bigint) as n_{k.name}"
    joined = lambda where: f"coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by o, s) filter (where kind is not null{where}), '')"
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents), f as ({" union all ".join(parts)})
      select doc_id, {", ".join(n(k) for k in BASE)}, sha256({joined(f" and o < {len(BASE)}")}) as base_sha256, {joined("")} as spans, {", ".join(n(k) for k in ADDED)}
      from d left join f using (r) group by r, doc_id"""


SQL = _sql()
