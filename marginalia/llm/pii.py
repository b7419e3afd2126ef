"""Personal data: base patterns and boosted candidates, with code-point spans.

Base spans are the leftmost non-overlapping matches of fixed patterns, each
checked. High-recall generators propose further spans: runs that may be
secrets, values assigned to secret names, keys with known prefixes, names and
passwords in URLs, bank numbers, grouped digits (phone and identity numbers),
runs of digits, identity numbers with letters, IPv6, written-out mail
addresses, street addresses and dates. Proposals overlap freely, with one
another and with base spans. Boosted trees score each from its
format and context, and those whose calibrated probability reaches their
generator's threshold are redacted. All selected spans are reported, so an
overlap never costs a span; ``redacted`` merges what overlaps.

The trees are fitted on FIT_ROWS generated examples a generator (the bound is
a parameter); everything else covers all rows and whole texts.

Defined cases: a null text has no spans; positions count code points; every
pattern enters a run only at its start or repeats a bounded number of times,
each match's context is cut while matching, and a candidate's features are
computed once, so ``detected`` takes time in proportion to the text and its
matches (``redacted`` copies the text once a span). What lies beyond a
generator's bounds is no candidate of it: written-out mail addresses with local
parts over 64 or labels over 63 characters, street names with words over 21
letters (31 before a joined ending), identity numbers over 14 characters.
Repeated rows repeat their result. Only doc_id and text are read; an empty
table gives an empty table.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.boosting import Boosted, boosted, calibrated, threshold
from marginalia.llm.common import documents, text_of
from marginalia.llm.pii_examples import EXAMPLES

#: The base patterns (no pattern here holds a single quote, so all can stand in SQL). Possessive where a match can't depend on backtracking; a run is entered only at its start or where a match has just ended.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A name that a value is assigned to, up to the value.
ASSIGNED = r"(?i)(?:passwor[dt]s?|passwd|kennwort|mot\x20de\x20passe|contraseña|pwd|passphrase|secret|token|key|credentials?|(?<![A-Z])(?:pw|pass|passcode|pin))[\x22\x27]?(?:\x20{0,2}[:=]\x20{0,2}|\x20(?:is|was|ist|est|es)\x20)[\x22\x27]?"
#: Month names in English, French, German and Spanish, short ones among them.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|"
    "Januar|Februar|März|Juni|Juli|Oktober|Dezember|"
    "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|"
    "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
)
DAY = r"[0-9]{1,2}(?:st|nd|rd|th|er|º|\.)?"
#: What keys of well-known services start with.
PREFIXES = r"A[KS]IA|gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|sk-|[rs]k_(?:live|test)_|whsec_|npm_|hf_|SG\.|ya29\.|AIza|eyJ|-----BEGIN"
GAP = r"\x20{0,2}[\[({<]?\x20?"
SHUT = r"\x20?[\])}>]?\x20{0,2}"
#: Generators of candidates.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "assigned": ASSIGNED + r"[^\s\x22\x27,;]{4,}+",
    "key": r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abeprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+|whsec_[A-Za-z0-9]{20,}+|npm_[A-Za-z0-9]{36,}+|hf_[A-Za-z0-9]{30,}+|SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+|ya29\.[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)",
    "login": r"(?<=://)[^\s/@:?#\x22\x27<>]*+:[^\s/@\x22\x27<>]++(?=@)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9A-Za-z.,+-])\(?[0-9]{1,8}\)?(?:[\x20./-]{1,2}\(?[0-9]{1,8}\)?){1,7}+(?![0-9A-Za-z])",
    "digits": r"(?<![0-9A-Za-z._-])[0-9]{7,19}+(?![0-9A-Za-z_-])",
    "identity": r"(?<![A-Za-z0-9_./-])(?:[A-Z]{1,3}[\x20-]?[0-9]{5,9}-?[A-Z]?|[0-9]{7,9}-?[A-Z]|[A-Z]{2}(?:\x20[0-9]{2}){3}\x20[A-Z]|(?=[A-Z]{0,9}[0-9])[A-Z][A-Z0-9]{7,9})(?![A-Za-z0-9_-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?!(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
    "mail": rf"(?i)(?<![{LOCAL}])[{LOCAL}]{{1,64}}+{GAP}(?:at|@){SHUT}(?<=[\x20\])}}>])[A-Z0-9-]{{1,63}}+(?:{GAP}(?:dot|punkt|punto|point){SHUT}(?<=[\x20\])}}>])[A-Z0-9-]{{2,24}}+|\.[A-Z0-9-]{{2,24}}+){{1,3}}+",
    "address": r"(?<![0-9A-Za-z])[0-9]{1,5}[a-zA-Z]?,?\x20(?:(?:\p{Lu}\p{L}{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way)(?!\p{L})|(?:rue|avenue|boulevard|place|chemin|impasse)(?:\x20\p{L}[\p{L}\x27-]{0,20}){1,3})|(?:(?<!\p{L})\p{Lu}[\p{L}-]{1,30}(?:straße|strasse|str\.|weg|platz|allee|gasse)|(?<!\p{L})(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)(?:\x20\p{L}{1,20}){1,4},?)\x20[0-9]{1,4}[a-z]?(?![0-9A-Za-z])",
    "date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:[0-9]{{4}}|[0-9]{{2}})|(?i:{DAY}[\x20-](?:of\x20|de\x20)?(?:{MONTHS})\.?,?[\x20-](?:de\x20|del\x20)?[0-9]{{4}}|(?:{MONTHS})\.?\x20{DAY},?\x20[0-9]{{4}}))(?![0-9A-Za-z])",
}
#: What each pattern can't match without: texts without it are not scanned.
NEEDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]",
    "card": "[0-9]{2}|[0-9][ -][0-9]",
    "phone": r"\+[0-9]",
    "secret": None,
    "assigned": "(?i)[:=]| (?:is|was|ist|est|es) ",
    "key": PREFIXES,
    "login": "://",
    "iban": "[A-Z]{2}[0-9]{2}",
    "number": r"[0-9]\)?[\x20./-]",
    "digits": "[0-9]{7}",
    "identity": "[A-Z][0-9]|[0-9]-?[A-Z]|[A-Z][ -][0-9]",
    "ipv6": ":[0-9A-Fa-f]{0,4}:",
    "mail": "(?i)(?:at|@)[ \\])}>]",
    "address": "[0-9]",
    "date": "[0-9][./-][0-9]{1,2}[./-][0-9]|[0-9A-Za-z.,][ -][0-9]{4}",
}
#: Kinds whose match starts with a name that is no part of the span.
LEADS = {"assigned": "^" + ASSIGNED}
FIT_ROWS = 2_000
PRECISION = 0.98
CONTEXT = 32
AFTER = 8
CHUNK = 128


#: Spans of the matches of one pattern within a chunk, from its start, and those of all chunks from the text's start.
IN_CHUNK = """aggregate(slice({k}_z, c * {size} + 1, least({size}, size({k}_m) - c * {size})),
  struct(0 AS at, CAST(array() AS array<{kind}>) AS out),
  (a, x) -> struct(a.at + x.{k}_g.n + length(x.{k}_m) AS at, concat(a.out, array(struct(
    a.at + x.{k}_g.n AS s, a.at + x.{k}_g.n + length(x.{k}_m) AS e, x.{k}_m AS m, x.{k}_g.b AS b, x.`2` AS a))) AS out))"""
IN_TEXT = """coalesce(flatten(transform(aggregate({k}_c,
  struct(0 AS at, CAST(array() AS array<struct<off:int,out:array<{kind}>>>) AS held),
  (a, x) -> struct(a.at + x.at AS at, concat(a.held, array(struct(a.at AS off, x.out AS out))) AS held), a -> a.held),
  p -> transform(p.out, x -> struct(x.s + p.off AS s, x.e + p.off AS e, x.m AS m, x.b AS b, x.a AS a)))), CAST(array() AS array<{kind}>))"""
SPAN = "struct<s:int,e:int,m:string,b:string,a:string>"


def located(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A column for each pattern over text ``t``: array of (s, e, m, b, a), the matches with their code-point spans and what stands before and after.

    Lengths of the text between matches and of the matches are added up within
    chunks, then across them, so no array is copied more than CHUNK times.
    """

    def step(form: str, suffix: str) -> None:
        nonlocal rows
        made = [F.expr(form.format(k=k, p=p, need=needs[k], size=CHUNK, kind=SPAN, context=CONTEXT, after=AFTER)).alias(f"{k}{suffix}") for k, p in patterns.items()]
        rows = rows.select("*", *made)

    needs = {k: "true" if NEEDS[k] is None else f"contains(t, '{NEEDS[k]}')" if len(NEEDS[k]) == 1 else f"rlike(t, r'{NEEDS[k]}')" for k in patterns}
    step("if({need}, regexp_extract_all(t, r'{p}', 0), null)", "_m")
    step("if(size({k}_m) > 0, transform(split(t, r'{p}', -1), x -> struct(length(x) AS n, right(x, {context}) AS b, left(x, {after}) AS a)), null)", "_g")
    step("if(size({k}_m) > 0, arrays_zip({k}_g, {k}_m, transform(slice({k}_g, 2, size({k}_m)), x -> x.a)), null)", "_z")
    step("if(size({k}_m) > 0, transform(sequence(0, CAST((size({k}_m) - 1) / {size} AS int)), c -> " + IN_CHUNK + "), null)", "_c")
    step(IN_TEXT, "")
    return rows.drop(*(f"{k}_{x}" for k in patterns for x in "mgzc"))


def digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(m: str) -> str:
    """SQL: whether the last digit in ``m`` checks the others."""
    value = "(ascii(c) - 48) * (1 + a.i % 2)"
    return f"aggregate(filter(split(reverse({digits_of(m)}), ''), c -> c != ''), struct(0 AS i, 0 AS s), (a, c) -> struct(a.i + 1 AS i, a.s + {value} - if({value} > 9, 9, 0) AS s), a -> a.s % 10 = 0)"


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


#: SQL: whether a base match ``x`` counts.
PASSES = {
    "email": "true",
    "ip": f"rlike(x.m, r'^{OCTET}(?:\\.{OCTET}){{3}}$')",
    "card": f"if(length({digits_of('x.m')}) BETWEEN 16 AND 19, {luhn('x.m')}, false)",
    "phone": f"length({digits_of('x.m')}) BETWEEN 8 AND 15",
}


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))


#: The end of a context, in words that both pattern languages read alike.
END = r"(?![\s\S])"
#: Features of a candidate, the same for fitting and scoring: counts and forms of the match by pattern, and its contexts.
COUNTS = ["[0-9]", "[a-f]", "[g-z]", "[A-Z]", "[aeiouAEIOU]", "[ .()/-]", "[_+/=]", "[!#$%&*?<>{}]", "[0-9][A-Za-z]|[A-Za-z][0-9]", ":", "[0-9]+", "[A-Za-z]+"]
FORMS = [
    f"^(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:[0-9]{{4}}|[0-9]{{2}})|[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}){END}",
    f"^[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?{END}",
    f"^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{END}",
    f"^[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}{END}",
    f"^0[1-9](?:[ .-][0-9]{{2}}){{4}}{END}",
    r"^[(]?0",
    "^(?:19|20)[0-9]{2}[^0-9]",
    f"^[0-9a-f]+{END}",
    "::",
    r"([0-9A-Za-z=_*-])\1{5}",
    f"^(?:{PREFIXES})",
    "[^A-Za-z](?:dot|DOT)[^A-Za-z]",
    r"[^A-Za-z](?:at|AT)[^A-Za-z ]|[\[({<](?:at|AT)|@",
    "[.](?:com|org|net|de|fr|es|io|co)" + END,
    "(?i)(?:^|[^a-z])(?:com|org|net|de|fr|es|io|co|edu)" + END,
    "(?:Street|Avenue|Road|Lane|Drive|Boulevard|rue|stra(?:ß|ss)e|Calle|avenue|boulevard)",
    f"^[A-Z]{{1,3}}[ -]?[0-9]{{5,9}}{END}",
    f"^(?:[A-Z]{{2}}[ ]?(?:[0-9]{{2}}[ ]?){{3}}[A-Z]|[XYZ]?[0-9]{{7,8}}-?[A-Z]){END}",
    r"^[^:]*:(?:[<{$*\[%]|(?i:password|passwd|pass|secret|token|xxx))",
    "(?i)^(?:[<{$*%]|null|none|true|false|required|undefined|changed|invalid|missing|wrong|optional|expired)",
]
BEFORE = [
    "(?i)(?:token|secret|passw|kennwort|de passe|contrase|pwd|api|key|auth|bearer|credential|passphrase|passcode|(?<![a-z])(?:pw|pass|pin)(?![a-z]))",
    "(?i)(?:phone|tel|call|mobile|cell|fax|number|handy|contact|ring|reach)",
    "(?i)(?:ssn|social|passport|passeport|pasaporte|reisepass|tax|national|licen[cs]e|permis|dni|(?<![a-z])(?:nie|nif|nino|id)(?![a-z])|identity|identit[éy]|ausweis|insurance|account|konto)",
    "(?i)(?:born|birth|dob|geb|n[ée]e? le|nacid)",
    "(?i)(?:iban|bank|account|konto|compte|transfer)",
    "(?i)(?:mail|contact|write)",
    "(?i)(?:live|address|adresse|wohn|ship|home|habite|direcc|visit)",
    rf"[=:][ \t]{{0,2}}[\x22\x27`]?{END}",
    rf"(?i) (?:is|was|ist|est|es) [\x22\x27`]?{END}",
    f"[\\x22\\x27`]{END}",
    f"[0-9][^0-9A-Za-z]{{0,3}}{END}",
    f"[/@#]{END}",
]
AFTERS = ["^[\\x22\\x27]", "^[^0-9A-Za-z]{0,2}[0-9]", "^[!]", "^[@/]"]
#: Longer matches count as failing these sums, which only short ones can pass.
SUMMED = 48


def remainder(m: str) -> str:
    """SQL: the rest by 97 of a bank number with its first four characters last and letters as 10 to 35."""
    bare = f"upper(regexp_replace({m}, '[^0-9A-Za-z]', ''))"
    value = "if(ascii(c) < 58, ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate(filter(split(concat(substr({bare}, 5), left({bare}, 4)), ''), c -> c != ''), 0, (a, c) -> (a * if(ascii(c) < 58, 10, 100) + {value}) % 97)"


def _remainder_here(m: str) -> int:
    bare = re.sub("[^0-9A-Za-z]", "", m).upper()
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]) or "0") % 97


def _luhn_here(m: str) -> bool:
    d = [int(c) for c in re.sub("[^0-9]", "", m)][::-1]
    return len(d) > 1 and sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def features(m: str, before: str, after: str) -> list[str]:
    """SQL of each feature of a match and its contexts."""
    short = f"length({m}) <= {SUMMED}"
    sums = [f"if({short}, {remainder(m)} = 1, false)", f"if({short} AND length({digits_of(m)}) > 1, {luhn(m)}, false)"]
    made = [f"length({m})", f"size(array_distinct(filter(split({m}, ''), c -> c != '')))", *(f"regexp_count({m}, r'{p}')" for p in COUNTS), *(f"rlike({m}, r'{p}')" for p in FORMS), *sums]
    made += [f"rlike({before}, r'{p}')" for p in BEFORE] + [f"rlike({after}, r'{p}')" for p in AFTERS]
    return [f"CAST({x} AS double)" for x in made]


def features_here(m: str, before: str, after: str) -> list[float]:
    count = lambda p: len(re.findall(p, m, re.ASCII))
    has = lambda p, s: bool(re.search(p, s, re.ASCII))
    short = len(m) <= SUMMED
    sums = [short and _remainder_here(m) == 1, short and _luhn_here(m)]
    return [float(x) for x in (len(m), len(set(m)), *(count(p) for p in COUNTS), *(has(p, m) for p in FORMS), *sums, *(has(p, before) for p in BEFORE), *(has(p, after) for p in AFTERS))]


@lru_cache(maxsize=4)
def models(fit_rows: int = FIT_ROWS, precision: float = PRECISION, seed: int = 7) -> dict[str, tuple[Boosted, float]]:
    """A calibrated model and its threshold for each generator; a third of the rows is held out for each."""
    out = {}
    for kind, make in EXAMPLES.items():
        rng = random.Random(f"{seed}{kind}")
        made = [make(rng) for _ in range(fit_rows)]
        x = np.array([features_here(m, b[-CONTEXT:], a[:AFTER]) for m, b, a, _ in made])
        y = np.array([float(label) for *_, label in made])
        a, b = fit_rows // 3, 2 * fit_rows // 3
        model = calibrated(boosted(x[:a], y[:a]), x[a:b], y[a:b])
        out[kind] = (model, max(0.5, threshold(model.probability(x[b:]), y[b:], precision)))
    return out


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array of (s, e, m) for each base kind and each generator."""
    rows = located(docs.select("doc_id", text_of().alias("t")), BASE | GENERATORS)
    fitted = models()
    bare = "x -> struct(x.s AS s, x.e AS e, x.m AS m)"

    def led(kind: str) -> str:
        """The candidates without the name they start with, which becomes context."""
        if kind not in LEADS:
            return kind
        lead = f"regexp_extract(x.m, r'{LEADS[kind]}', 0)"
        return f"transform({kind}, x -> struct(x.s + length({lead}) AS s, x.e AS e, substr(x.m, length({lead}) + 1) AS m, right(concat(x.b, {lead}), {CONTEXT}) AS b, x.a AS a))"

    def featured(kind: str) -> str:
        """The candidates with those features that their trees ask for."""
        every = features("x.m", "x.b", "x.a")
        return f"transform({kind}, x -> struct(x.s AS s, x.e AS e, x.m AS m{''.join(f', {every[i]} AS f{i}' for i in fitted[kind][0].used())}))"

    def selected(kind: str) -> str:
        model, cut = fitted[kind]
        return f"transform(filter({kind}, x -> {model.sql('x')} >= {cut!r}D), {bare})"

    checked = [F.expr(f"transform(filter({k}, x -> {PASSES[k]}), {bare})").alias(k) for k in BASE]
    rows = rows.select("doc_id", "t", *checked, *(F.expr(led(k)).alias(k) for k in GENERATORS))
    rows = rows.select("doc_id", "t", *BASE, *(F.expr(featured(k)).alias(k) for k in GENERATORS))
    return rows.select("doc_id", "t", *BASE, *(F.expr(selected(k)).alias(k) for k in GENERATORS))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    return F.array_join(F.concat(*(F.transform(k, _written(k)) for k in kinds)), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, spans and the text with every span replaced by its kind in brackets; overlapping spans merge under the first."""
    rows = detected(docs)
    kinds = [*BASE, *GENERATORS]
    every = F.array_sort(F.concat(*(F.transform(k, _named(k)) for k in kinds)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        part = F.concat(a["out"], F.substr(F.col("t"), a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["k"], F.lit("]"))
        return F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), part.alias("out"))).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))

    rows = rows.withColumn("every", every)
    done = F.aggregate("every", start, step, lambda a: F.concat(a["out"], F.substr(F.col("t"), a["at"] + 1, F.length("t"))))
    return rows.select("doc_id", listed(kinds).alias("spans"), done.alias("redacted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(documents(spark, sf_dir))
    rows = rows.withColumn("base", listed(list(BASE)))
    return rows.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE), F.sha2("base", 256).alias("base_sha256"), listed([*BASE, *GENERATORS]).alias("spans"))
