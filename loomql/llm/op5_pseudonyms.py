"""PII: format-preserving pseudonyms from keyed Feistel permutations.

Found values are checked (Luhn, IBAN remainder, octets, calendar, social security areas) and replaced by another value
of the same format, by a permutation that depends only on the key and the kind of value: equal values get equal
pseudonyms in every document, different ones different pseudonyms, and whoever holds the key can reverse them.

* Text-like values (e-mail addresses, secrets, phone digits, cards, IBANs) go through a Feistel network over
  their characters: the left half of the permutable characters is shifted by a hash of the right half, then
  the other way round, ``ROUNDS`` times; each character stays in its class (digit, lower, upper, or hex), others
  stay as they are.  Cards and IBANs then get the check digits of their new body.
* Pairs of numbers (dates as days in 17 x 4297, which is exactly 1900-01-01 to 2099-12-31; addresses as 2^16 x 2^16;
  social security numbers as 29634 x 29997, which is exactly the 898 valid areas x 99 groups x 9999 serial numbers)
  go through the same network with modular addition, so no cycle walking is needed and every pseudonym passes its check.

The key is the session's setting ``spark.loomql.pii.key``.  Without it a public key is used, with a warning: whoever knows it can
reverse the pseudonyms.

A phone number keeps its country code, an e-mail address its top-level domain, a secret its name.  A secret is the
run of letters, digits and ``+/_-.`` after a name such as ``token`` and a colon or equals sign, of any length, if it
holds a digit; one of more than ``PART`` characters is permuted in parts.  Upper-case words or numbers that an IBAN
stands next to are tried with and without.  Only texts with a digit or an ``@`` are searched at all; everything is
DataFrame expressions.

Defined cases: a null text stays null and has no findings, an empty one stays empty, a very long one is searched whole; numbers
that fail their check stay; repeated rows all stay; an empty table gives none; extra columns are kept as they are whatever their
names.  Days and months of 1/2/1990 are read month first if that is a date; other separators day first.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY, KEY_SETTING = "change-this-key", "spark.loomql.pii.key"
KINDS = ("email", "secret", "iban", "ip", "phone", "date", "ssn", "card")

#: Patterns of each kind, tried in this order at every place; group 1 of the whole is the secret.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"""((?<=["'=:\s])(?<=(?i:token|secret|api.?key|passw(?:or)?d)["']?\s{0,3}[:=]\s{0,3}["']?)(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]*[A-Za-z0-9+/_\-])""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:(?:19|20)[0-9]{2}([\-/.])[0-9]{1,2}\2[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\3(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[\-/.][0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\4[0-9]{4}\4[0-9]{4}|[0-9]{4}([ \-])[0-9]{6}\5[0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
#: What a secret's name needs; texts without it are not searched for secrets once more.
NAMES = r"(?i)token|secret|api.?key|passw(?:or)?d"
#: Longer secrets are permuted in parts of at most so many characters, as a permutation's cost grows with the square of its length.
PART = 128
_PIECES = "array<struct<kind: string, v: string>>"


def _sql(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(key: str, tag: str, turn: str, other: str, at: str, tweak: str = "''") -> str:
    """The keyed number that round ``turn`` adds at place ``at``, from the joined other half."""
    digest = f"sha2(concat({_sql(key + '|' + tag + '|')}, {turn}, '|', {tweak}, array_join({other}, ',')), 512)"
    return f"cast(conv(substring({digest}, 4 * ({at} % 32) + 1, 4), 16, 10) as int)"


def feistel_text(value: str, key: str, tag: str, hexadecimal: bool = False, tweak: str = "''") -> str:
    """SQL for the pseudonym of string ``value`` (an SQL expression): characters permuted within their classes.

    Each value of ``tweak`` (an SQL expression) has its own permutation.
    """
    chars = f"regexp_extract_all({value}, '(?s).', 0)"
    if hexadecimal:
        code = "instr('0123456789abcdef', c) - 1"
        made = f"transform({chars}, c -> named_struct('c', c, 'v', {code}, 'r', if({code} >= 0, 16, 1), 'a', 0))"
    else:
        made = f"""transform({chars}, c -> CASE WHEN c BETWEEN '0' AND '9' THEN named_struct('c', c, 'v', ascii(c) - 48, 'r', 10, 'a', 48)
            WHEN c BETWEEN 'a' AND 'z' THEN named_struct('c', c, 'v', ascii(c) - 97, 'r', 26, 'a', 97)
            WHEN c BETWEEN 'A' AND 'Z' THEN named_struct('c', c, 'v', ascii(c) - 65, 'r', 26, 'a', 65)
            ELSE named_struct('c', c, 'v', 0, 'r', 1, 'a', 0) END)"""
    # one-row let: cs, then the two halves of what can be permuted
    moved = "filter(cs, x -> x.r > 1)"
    half = f"int(size({moved}) / 2)"
    start = f"named_struct('l', transform(slice({moved}, 1, {half}), x -> x.v), 'r', transform(slice({moved}, {half} + 1, 1000000), x -> x.v))"
    left_r, right_r = f"transform(slice({moved}, 1, {half}), x -> x.r)", f"transform(slice({moved}, {half} + 1, 1000000), x -> x.r)"
    go_left = f"transform(s.l, (x, i) -> (x + {_shift(key, tag, 'k', 's.r', 'i', tweak)}) % element_at({left_r}, i + 1))"
    go_right = f"transform(s.r, (x, i) -> (x + {_shift(key, tag, 'k', 's.l', 'i', tweak)}) % element_at({right_r}, i + 1))"
    ends = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> if(k % 2 = 1, named_struct('l', {go_left}, 'r', s.r), named_struct('l', s.l, 'r', {go_right})), s -> concat(s.l, s.r))"
    letter = "substring('0123456789abcdef', element_at(vs, n) + 1, 1)" if hexadecimal else "char(x.a + element_at(vs, n))"
    out = f"array_join(transform(cs, (x, i) -> if(x.r = 1, x.c, transform(array(size(filter(slice(cs, 1, i + 1), y -> y.r > 1))), n -> {letter})[0])), '')"
    return f"transform(transform(array({made}), cs -> named_struct('cs', cs, 'vs', {ends})), t -> transform(array(t.cs), cs -> transform(array(t.vs), vs -> {out})[0])[0])[0]"


def feistel_pair(number: str, low: int, high: int, key: str, tag: str) -> str:
    """SQL for the permutation of an integer below high * low, as (number div low, number mod low)."""
    add = lambda other: _shift(key, tag, "k", f"array({other})", "0")
    start = f"named_struct('l', cast({number} as bigint) div {low}, 'r', cast({number} as bigint) % {low})"
    step = f"if(k % 2 = 1, named_struct('l', (s.l + {add('s.r')}) % {high}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {add('s.l')}) % {low}))"
    return f"aggregate(sequence(1, {ROUNDS + 2}), {start}, (s, k) -> {step}, s -> s.l * {low} + s.r)"


def _luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of digits whose last one is doubled first (a body without its check digit)."""
    return f"aggregate(transform(regexp_extract_all(reverse({digits}), '.', 0), (c, i) -> if(i % 2 = 0, if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (a, x) -> a + x)"


def _only_digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _card(m: str, key: str) -> str:
    body, last = f"substring({m}, 1, length({m}) - 1)", f"int(substring({m}, -1, 1))"
    ok = f"({_luhn_sum(_only_digits(body))} + {last}) % 10 = 0"
    return f"if({ok}, transform(array({feistel_text(body, key, 'card')}), b -> concat(b, string((10 - {_luhn_sum(_only_digits('b'))} % 10) % 10)))[0], {m})"


def _iban_rest(body_then_head: str) -> str:
    """SQL for the remainder by 97 of an IBAN turned round (body, country, check digits)."""
    return f"aggregate(regexp_extract_all(replace({body_then_head}, ' ', ''), '.', 0), 0, (a, c) -> if(c BETWEEN '0' AND '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _iban_holds(m: str) -> str:
    """SQL for whether a value of an IBAN's shape passes its check."""
    return f"(length(replace({m}, ' ', '')) >= 15 AND {_iban_rest(f'concat(substring({m}, 5), substring({m}, 1, 4))')} = 1)"


def _iban_pieces(m: str) -> str:
    """SQL for the pieces (kind, v) of a match of the IBAN pattern, which also takes groups that follow or precede the IBAN.

    From each group on, the longest run of whole groups that passes the check is the IBAN; what is
    left in between (kind null) is searched for the other kinds.  A match without any finding is one piece.
    """
    run = "array_join(slice(ws, i, n), ' ')"
    runs = f"filter(transform(sequence(size(ws) - i + 1, 1, -1), n -> {run}), r -> r RLIKE '^[A-Z]{{2}}[0-9]{{2}}[ A-Z0-9]+$' AND {_iban_holds('r')})"
    space = "if(i = 1, '', ' ')"
    plain = f"named_struct('p', s.p, 'left', concat(s.left, {space}, ws[i - 1]), 'next', i + 1)"
    found = f"named_struct('p', concat(s.p, array(named_struct('kind', cast(null as string), 'v', concat(s.left, {space})), named_struct('kind', 'iban', 'v', r))), 'left', '', 'next', i + size(split(r, ' ')))"
    step = f"if(i < s.next, s, transform(array(get({runs}, 0)), r -> if(r IS NULL, {plain}, {found}))[0])"
    scan = f"aggregate(sequence(1, size(ws)), named_struct('p', cast(array() as {_PIECES}), 'left', '', 'next', 1), (s, i) -> {step}, s -> concat(s.p, array(named_struct('kind', cast(null as string), 'v', s.left))))"
    rest = _sql("|".join(PATTERNS[k] for k in KINDS).replace(PATTERNS["iban"], "(?!)"))
    hits = f"transform(regexp_extract_all(p.v, {rest}, 0), v -> named_struct('kind', {_kind_of('v')}, 'v', v))"
    gaps = f"transform(split(p.v, {rest}, -1), v -> named_struct('kind', cast(null as string), 'v', v))"
    inside = f"flatten(zip_with({gaps}, {hits}, (g, h) -> if(h IS NULL, array(g), array(g, h))))"
    pieces = f"transform(array(split({m}, ' ')), ws -> flatten(transform({scan}, p -> if(p.kind IS NULL, {inside}, array(p)))))[0]"
    whole = f"array(named_struct('kind', 'iban', 'v', {m}))"
    return f"if({_iban_holds(m)}, {whole}, transform(array({pieces}), ps -> if(exists(ps, p -> p.kind IS NOT NULL), ps, {whole}))[0])"


def _iban(m: str, key: str) -> str:
    country, body = f"substring({m}, 1, 2)", f"substring({m}, 5)"
    ok = _iban_holds(m)
    new_check = f"lpad(string(98 - {_iban_rest(f'''concat(b, {country}, '00')''')}), 2, '0')"
    return f"if({ok}, transform(array({feistel_text(body, key, 'iban')}), b -> concat({country}, {new_check}, b))[0], {m})"


def _ip(m: str, key: str) -> str:
    parts = f"transform(split({m}, '[.]'), x -> bigint(x))"
    number = f"aggregate({parts}, 0L, (a, x) -> a * 256 + x)"
    new = feistel_pair(number, 65536, 65536, key, "ip")
    return f"if(forall({parts}, x -> x <= 255), transform(array({new}), n -> concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256))[0], {m})"


def _date(m: str, key: str) -> str:
    part = lambda i: f"split({m}, '[-/.]')[{i}]"
    sep = f"regexp_extract({m}, '[-/.]', 0)"
    day = lambda y, mo, d: f"date(try_to_timestamp(concat_ws('-', {part(y)}, {part(mo)}, {part(d)}), 'yyyy-M-d'))"
    year_first = f"length({part(0)}) = 4"
    month_first = f"{sep} = '/' AND {day(2, 0, 1)} IS NOT NULL"
    found = f"CASE WHEN {year_first} THEN {day(0, 1, 2)} WHEN {month_first} THEN {day(2, 0, 1)} ELSE {day(2, 1, 0)} END"
    number = f"datediff({found}, date'1900-01-01')"
    new = f"date_add(date'1900-01-01', int({feistel_pair(number, 4297, 17, key, 'date')}))"
    bare = f"{m} RLIKE '(?<![0-9])[1-9](?![0-9])'"
    two = lambda x: f"if({bare}, string({x}), lpad(string({x}), 2, '0'))"
    shown = f"CASE WHEN {year_first} THEN concat_ws({sep}, string(year(n)), {two('month(n)')}, {two('day(n)')}) WHEN {month_first} THEN concat_ws({sep}, {two('month(n)')}, {two('day(n)')}, string(year(n))) ELSE concat_ws({sep}, {two('day(n)')}, {two('month(n)')}, string(year(n))) END"
    return f"if({found} IS NOT NULL, transform(array({new}), n -> {shown})[0], {m})"


def _ssn(m: str, key: str) -> str:
    area, group, serial = f"int(substring({m}, 1, 3))", f"int(substring({m}, 5, 2))", f"int(substring({m}, 8, 4))"
    number = f"((cast({area} as bigint) - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    new = feistel_pair(f"({number})", 29997, 29634, key, "ssn")
    shown = "concat_ws('-', lpad(string(n div 989901 + if(n div 989901 >= 665, 2, 1)), 3, '0'), lpad(string(n div 9999 % 99 + 1), 2, '0'), lpad(string(n % 9999 + 1), 4, '0'))"
    return f"transform(array({new}), n -> {shown})[0]"


def _email(m: str, key: str) -> str:
    body, end = f"regexp_extract({m}, '^(.*[.])[A-Za-z]+$', 1)", f"regexp_extract({m}, '[A-Za-z]+$', 0)"
    return f"concat({feistel_text(body, key, 'email')}, {end})"


def _secret(m: str, key: str) -> str:
    def made(value: str, hexadecimal: bool = False) -> str:
        parts = f"int(ceil(length(u) / {PART}))"
        size = f"int(ceil(length(u) / {parts}))"
        tweak = f"if({parts} = 1, '', concat(j, '|'))"
        part = feistel_text(f"substring(u, j * {size} + 1, {size})", key, "secret", hexadecimal, tweak)
        return f"transform(array({value}), u -> array_join(transform(sequence(0, {parts} - 1), j -> {part}), ''))[0]"

    as_hex = made(f"lower({m})", hexadecimal=True)
    return f"CASE WHEN {m} RLIKE '^[0-9a-f]+$' THEN {as_hex} WHEN {m} RLIKE '^[0-9A-F]+$' THEN upper({as_hex}) ELSE {made(m)} END"


def _phone(m: str, key: str) -> str:
    code = f"regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[^0-9])', 0)"
    return f"concat({code}, {feistel_text(f'substring({m}, length({code}) + 1)', key, 'phone')})"


def pseudonym(kind: str, m: str, key: str) -> str:
    """SQL for the pseudonym of a found value; a value that fails its check is returned as it is."""
    made = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "phone": _phone, "date": _date, "ssn": _ssn, "card": _card}
    return made[kind](m, key)


def _kind_of(m: str) -> str:
    """SQL for the kind of a match that is no secret, by its own shape (the places around it were checked when it was found)."""
    plain = {
        "email": "@",
        "iban": "^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$",
        "ip": r"^[0-9]{1,3}([.][0-9]{1,3}){3}$",
        "date": r"^([0-9]{4}([-/.])[0-9]{1,2}\\2[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\\3[0-9]{4})$",
        "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        "card": r"^([0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\\2[0-9]{4}\\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\\3[0-9]{5})$",
    }
    return "CASE " + " ".join(f"WHEN {m} RLIKE '{p}' THEN '{k}'" for k, p in plain.items()) + " ELSE 'phone' END"


def key_of(spark: SparkSession) -> str:
    """The session's key; the public one where none is set."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: pseudonyms are made with a public key", stacklevel=2)
    return key or KEY


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """(row, text, found): the input row as a struct, its new text, and (kind, pseudonym, changed) of each finding in order."""
    key = key_of(docs.sparkSession) if key is None else key
    text = F.col(f"`{column}`").cast("string")
    searched = F.when(F.regexp_like(text, F.lit("[0-9@]")), text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), F.regexp_extract_all(searched, F.lit(ANY), F.lit(0)).alias("m"))
    rows = rows.withColumn("m", F.when(F.size("m") > 0, F.col("m")))
    rows = rows.withColumn("secrets", F.when(F.col("m").isNotNull() & F.regexp_like("t", F.lit(NAMES)), F.regexp_extract_all("t", F.lit(ANY), F.lit(1))))
    kind = f"if(get(secrets, i) != '', 'secret', {_kind_of('v')})"  # the pattern says what is a secret: it may look like any other kind
    pieces = f"transform(array({kind}), kind -> if(kind = 'iban', {_iban_pieces('v')}, array(named_struct('kind', kind, 'v', v))))[0]"
    rows = rows.withColumn("k", F.expr(f"transform(m, (v, i) -> {pieces})"))
    replaced = "CASE " + " ".join(f"WHEN x.kind = '{k}' THEN {pseudonym(k, 'x.v', key)}" for k in KINDS) + " ELSE x.v END"
    rows = rows.withColumn("done", F.expr(f"transform(k, xs -> transform(xs, x -> transform(array({replaced}), p -> named_struct('kind', x.kind, 'pseudonym', p, 'changed', p != x.v))[0]))"))
    rows = rows.withColumn("found", F.expr("filter(flatten(done), f -> f.kind IS NOT NULL)"))
    between = F.split("t", ANY, -1)
    shown = F.transform("done", lambda fs: F.array_join(F.transform(fs, lambda f: f["pseudonym"]), ""))
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(shown, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return rows.select("row", F.when(F.col("found").isNull(), F.col("t")).otherwise(joined).alias("text"), "found")


def op5_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_found, kinds): every text with its values replaced, and how many of which kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    changed = F.filter("found", lambda f: f["changed"])
    done = pseudonymise(docs).select(F.col("row.doc_id").alias("doc_id"), "text", F.coalesce(changed, F.array().cast("array<struct<kind:string,pseudonym:string,changed:boolean>>")).alias("c"))
    return done.select("doc_id", "text", F.size("c").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("c", lambda f: f["kind"]))), ",").alias("kinds"))
