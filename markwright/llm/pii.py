"""Personal data by candidate gradient boosting, in DataFrame functions only.

Four exact patterns (email, ip, card, phone) and their checks (octets, Luhn digit, digit counts) give the base spans;
those are final. Beside them, generators of high recall propose further candidates, which may overlap each other and the
exact forms: addresses and numbers in obfuscated or loosely grouped forms, values that a name such as `token` announces,
and long mixed runs. Format features (digits, groups, checks) and context features (what stands before and after)
describe a candidate, gradient-boosted trees score it, and a threshold for each kind, calibrated for precision on
candidates kept aside, selects the spans that are added to the base ones. What a base span covers whole is not added.

No table says which candidates are personal data, so the trees learn from the corpus itself and from made spans:
distinct valid base spans, as they stand and rewritten into the forms that the generators look for, against the same
spans made invalid, and against the corpus' own matches of the exact patterns that failed their check. About BOUND spans
are used; their features are collected, the trees are fit on the driver in numpy and go to the tasks as one literal,
which an expression walks.

Spans are [start, end) in code points. Defined cases: a null text is an empty one and has no spans; rows that repeat a
doc_id and null ids are judged by themselves; extra columns of any name are ignored, and kept by redact; a corpus without
base spans is judged by trees that learned from made spans; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm.common import cut, stratified

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with an exact pattern.
BASE = 4
#: Spans that the trees learn from, about so many at most, beside MADE for each kind that depend on no table.
BOUND, MADE = 2000, 40
PRECISION = 0.98
TREES, DEPTH, RATE = 24, 4, 0.3
BLOCK = 256

# The patterns of the four kinds. Possessive quantifiers and a look behind (or the end of the last match) keep them linear
# in the length of the text; they match what the plain forms match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The generators of further candidates.
# Names have at most 127 labels; nothing else that a form can repeat has a bound.
MAIL_LIKE = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|[(\[{<]\s?at\s?[)\]}>])\s?[A-Za-z0-9-]++(?:\s?(?:\.|[(\[{<]\s?dot\s?[)\]}>])\s?[A-Za-z0-9-]++){1,126}+"
MAIL_SPOKEN = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\sat\s[A-Za-z0-9-]++(?:\sdot\s[A-Za-z0-9-]++){1,126}+"
SIX = r"(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|(?=[A-Fa-f:]*+[0-9])(?:[0-9A-Fa-f]{1,4}+:){1,6}+(?::[0-9A-Fa-f]{1,4}+){1,6}+"
IP_LIKE = r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+(?:\[\.\]|\(\.\))[0-9]{1,3}+|" + SIX + r")(?![0-9A-Za-z:]|\.[0-9A-Za-z])"
NUMBER_LIKE = r"(?<![0-9])[(]?[0-9]++(?:[\x20().\/-]{1,3}+[0-9]++)*+"
NAMED = r"(?i)(?<![A-Za-z0-9])(?:token|secret|passw(?:or)?d|pwd|credential|(?:api|access|private|secret|auth)[_-]?(?:key|token))[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
SECRET_LIKE = NAMED + r"[A-Za-z0-9+\/_.=~!$%^&*-]{8,}+"
RUN_LIKE = r"(?<![A-Za-z0-9+\/_-])(?=[A-Za-z+\/_-]*+[0-9])[A-Za-z0-9+\/_-]{32,}+"
#: What every match of a pattern or generator has.
ANY = r"[0-9@]|(?i:[(\[{<]\s?at\s?[)\]}>]|\sdot\s)|[:=]\s{0,3}[\"']?[A-Za-z0-9+\/_.=~!$%^&*-]{8}"
#: kind, start, end, text, 32 characters before and after; form: 2 an exact form that is valid, 1 one that is not, 0 a proposal.
MATCHES = "array<struct<k:int,s:int,e:int,m:string,l:string,r:string,form:int>>"

WORDS = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel|write to|schreib",
    "ip": r"(?i)\bip\b|host|server|addr|login",
    "card": r"(?i)card|karte|carte|tarjeta|visa|master|credit|kredit|payment",
    "phone": r"(?i)phone|\btel|call|fax|mobil|móvil|handy|télé|ruf",
    "secret": NAMED + r"\z",
}
DATE = r"\A(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2})\z"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, first: int, add: Callable[[Column, Column], Column]) -> Column:
    """For an array of ints the fold of what stands before each place, block by block, so that the cost is in proportion."""
    zero = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))

    def before(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def folded(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), add))
        starts = F.aggregate(sums, zero, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, before))

    cuts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    return once(values, lambda v: once(cuts(v), folded))


def matches(text: Column, pattern: str, kind: int, form: Callable[[Column], Column] = lambda m: F.lit(0)) -> Column:
    """The matches of a pattern with their places and contexts."""

    def whole(x: Column, r: Column) -> Column:
        return F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["l"].alias("l"), F.substring(F.coalesce(r, F.lit("")), 1, 32).alias("r"), form(x["m"]).alias("form"))

    def placed(pieces: Column, found: Column) -> Column:
        sizes = F.zip_with(pieces, found, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
        rows = F.zip_with(F.arrays_zip(pieces.alias("p"), running(sizes, 0, lambda a, x: a + x).alias("at")), found, lambda x, m: F.struct((x["at"] + F.length(x["p"])).alias("s"), m.alias("m"), F.right(x["p"], F.lit(32)).alias("l")))
        after = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
        return F.filter(F.zip_with(rows, after, whole), lambda x: x["m"].isNotNull())

    return once(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), lambda t: placed(t["pieces"], t["found"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def passes(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i + 1, F.lit(1)).try_cast("int")
            return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.coalesce(value(i), F.lit(1))), F.lit(0), lambda a, x: a + x) % 10 == 0

    return once(d, passes)


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\z"))


def _is_card(m: Column) -> Column:
    return once(digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))


def candidates(text: Column) -> Column:
    """All matches of the exact patterns by kind and start, then all proposals; null without any."""
    checked = lambda check: lambda m: F.when(check(m), 2).otherwise(1)
    many = text.rlike(r"[0-9](?:[\x20().\/-]{0,3}[0-9]){6}")
    parts = [
        F.when(text.contains("@"), matches(text, EMAIL, 0, lambda m: F.lit(2))),
        F.when(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, 1, checked(octets))),
        # Shorter runs of digits are no card, and no proposal either.
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(matches(text, CARD, 2, checked(_is_card)), lambda x: F.length(digits(x["m"])) >= 13)),
        F.when(text.contains("+"), matches(text, PHONE, 3, checked(lambda m: F.length(digits(m)).between(8, 15)))),
        F.when(text.rlike(r"(?i)@|[(\[{<]\s?at\s?[)\]}>]"), matches(text, MAIL_LIKE, 0)),
        F.when(text.rlike(r"(?i)\sdot\s"), matches(text, MAIL_SPOKEN, 0)),
        F.when(text.rlike(r"[0-9](?:\[\.\]|\(\.\))|[0-9A-Fa-f]::?[0-9A-Fa-f]"), matches(text, IP_LIKE, 1)),
        F.when(many, F.transform(F.filter(matches(text, NUMBER_LIKE, 3), lambda x: F.length(digits(x["m"])).between(7, 19)), lambda x: x.withField("k", F.when(F.length(digits(x["m"])) >= 13, 2).otherwise(3)))),
        F.when(text.rlike(SECRET_LIKE), F.transform(matches(text, SECRET_LIKE, 4), _value)),
        F.when(text.rlike(r"[A-Za-z0-9+\/_-]{32}"), matches(text, RUN_LIKE, 4)),
    ]
    none = F.array().cast(MATCHES)
    return F.concat(*(F.coalesce(p.cast(MATCHES), none) for p in parts))


def _value(x: Column) -> Column:
    """A named value without its name, which goes to the context."""
    value = F.regexp_replace(x["m"], r"\A" + NAMED, "")
    shift = F.length(x["m"]) - F.length(value)
    return F.struct(x["k"].alias("k"), (x["s"] + shift).alias("s"), x["e"].alias("e"), value.alias("m"), F.right(F.concat(x["l"], F.substring(x["m"], F.lit(1), shift)), F.lit(32)).alias("l"), x["r"].alias("r"), x["form"].alias("form"))


FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "is_secret", "digits", "length", "separators", "luhn", "groups", "longest_group", "open_left", "open_right", "plus", "brackets", "word_before", "digits_around", "zero",
    "date", "octets", "host_ends", "network", "distinct", "mixed",
)


def features(k: Column, m: Column, left: Column, right: Column) -> Column:
    """The features of a candidate, in the order of FEATURES."""
    return once(digits(m), lambda d: _features(k, m, left, right, d))


def _features(k: Column, m: Column, left: Column, right: Column, d: Column) -> Column:
    groups = F.filter(F.split(m, r"[^0-9A-Za-z]+"), lambda g: g != "")
    before = F.lit(False)
    for i, pattern in enumerate(WORDS.values()):
        before = before | ((k == i) & left.rlike(pattern))
    plain = F.regexp_replace(F.regexp_replace(m, r"(?i)\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s", "."), r"(?i)\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s", "@")
    values = (
        k == 0, k == 1, k == 2, k == 3, k == 4, F.length(d), F.length(m), F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), (k == 2) & luhn(d), F.size(groups), F.array_max(F.transform(groups, lambda g: F.length(g))),
        ~left.rlike(r"[0-9A-Za-z._-]\z"), ~right.rlike(r"\A[0-9A-Za-z_-]"), m.startswith("+") | left.rlike(r"\+\z"), m.rlike(r"[()\[\]]"), before, F.length(digits(F.concat(left, right))), d.startswith("0"), m.rlike(DATE),
        plain.rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z") & octets(plain), plain.rlike(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}\z"), m.rlike(r"\A(?:" + SIX + r")\z"),
        # The ends tell a long value's kind.
        F.size(F.array_distinct(F.split(F.concat(F.left(m, F.lit(256)), F.right(m, F.lit(256))), ""))), m.rlike("[A-Za-z]") & (F.length(d) > 0),
    )
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


def made_spans(spark: SparkSession) -> DataFrame:
    """(k, m, l, r): MADE spans of each exact kind from hashes of numbers, so that the trees need no corpus to learn from."""
    digit = lambda n, salt: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**n)).cast("string"), n, "7")
    letters = lambda salt: F.substring(F.translate(digit(7, salt), "0123456789", "aeioucntrs"), F.lit(1), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int") + 4)
    body = F.concat(F.lit("4"), digit(14, "card"))
    check = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: luhn(F.concat(body, c.cast("string")))), F.lit(0)).cast("string")
    octet = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(254)) + 1).cast("string")
    of = (
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("user"), digit(3, "user"), F.lit("@mail"), digit(1, "host"), F.lit(".example.com"))).otherwise(F.concat(letters("user"), F.lit("@"), letters("host"), F.lit(".org"))), F.concat_ws(".", *(octet(f"octet{i}") for i in range(4))), F.concat(body, check),
        F.concat(F.lit("+1 ("), digit(3, "area"), F.lit(") 555-"), digit(4, "line")),
    )
    rows = F.array(*(F.struct(F.lit(k).alias("k"), m.alias("m"), F.lit(" it says ").alias("l"), F.lit(" and goes on").alias("r")) for k, m in enumerate(of)))
    return spark.range(MADE).select(F.inline(rows))


def examples(spans: DataFrame) -> DataFrame:
    """(k, x, label, aside) from (k, m, l, r, form): valid spans as they stand, rewritten, and made invalid; failed matches as they are."""
    k, m, left, right = (F.col(c) for c in ("k", "m", "l", "r"))
    d = digits(m)
    bare = F.regexp_replace(m, r"^\+", "")
    last = (F.right(d, F.lit(1)).try_cast("int") + 1) % 10
    turned = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), last.cast("string"))
    grouped = F.regexp_replace(d, r"(?<=\A(?:[0-9]{4}){1,4})(?=[0-9])", ".")
    year = F.concat(F.lit("20"), F.substring(F.lpad(F.pmod(F.xxhash64("m"), F.lit(90)).cast("string"), 2, "1"), 1, 2), F.lit("-0"), F.pmod(F.xxhash64("l"), F.lit(9)) + 1, F.lit("-1"), F.pmod(F.xxhash64("r"), F.lit(9)))
    many = F.regexp_replace(m, r"\A[0-9]+", "312")
    key = F.substring(F.sha2(m, 256), 1, 40)
    name = F.concat(left, F.element_at(F.array(*map(F.lit, ('token = "', "secret: ", 'api_key="', "password = ", "access-token: '"))), (F.pmod(F.xxhash64("m"), F.lit(5)) + 1).cast("int")))
    word = F.concat(F.substring(F.regexp_replace(F.concat(left, right), "[^A-Za-z]", ""), 1, 14), F.lit("ingly"))

    def made(*of: tuple) -> Column:
        """From (kind, text, label[, left])."""
        return F.array(*(F.struct(F.lit(x[0]).alias("k"), x[1].alias("m"), F.lit(x[2]).alias("label"), (x[3] if len(x) > 3 else left).alias("l")) for x in of))

    rows = F.when(k == 0, made((0, m, 1), (0, F.replace(m, F.lit("@"), F.lit(" (at) ")), 1), (0, F.replace(F.replace(m, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), 1), (0, F.replace(F.replace(m, F.lit("@"), F.lit("[at]")), F.lit("."), F.lit("[dot]")), 1), (0, F.replace(F.replace(m, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot ")), 1), (0, F.regexp_replace(m, r"\..*\z", ""), 0), (0, F.regexp_replace(m, r"@.*\z", " [at] 12.5"), 0), (0, F.regexp_replace(m, r"@.*\z", " at 7 dot 5"), 0)))
    hexed = F.lower(F.hex(F.xxhash64("m")))
    six = F.regexp_replace(F.lpad(hexed, 16, "0"), r"([0-9a-f]{4})(?=[0-9a-f])", "$1:")
    rows = rows.when(k == 1, made((1, m, 1), (1, F.concat(F.lit("2001:db8::"), F.right(hexed, F.lit(3))), 1), (1, F.concat(F.lit("fe80::"), F.right(six, F.lit(14))), 1), (1, F.concat(six, F.lit(":"), six), 1), (1, F.regexp_replace(m, r"\A([0-9]+)\.([0-9]+)\..*\z", "$1::$2"), 0), (1, F.replace(m, F.lit("."), F.lit("[.]")), 1), (1, many, 0), (1, F.replace(F.regexp_replace(m, r"[0-9]+\z", "799"), F.lit("."), F.lit("(.)")), 0), (3, m, 0), (3, many, 0)))
    rows = rows.when(k == 2, made((2, m, 1), (2, grouped, 1), (2, turned, 0), (2, F.substring(turned, 1, 14), 0), (2, F.concat(F.substring(d, 1, 4), F.lit(" "), turned), 0), (3, F.substring(d, 1, 11), 0)))
    rows = rows.otherwise(made((3, m, 1), (3, bare, 1), (3, F.concat(F.lit("("), F.substring(d, 2, 3), F.lit(") "), F.substring(d, 5, 3), F.lit("-"), F.substring(d, 8, 4)), 1), (3, F.substring(d, 1, 7), 0), (3, d, 0), (3, year, 0), (3, F.concat(F.substring(d, 1, 4), F.lit("."), F.substring(d, 5, 4)), 0), (2, F.concat(d, d), 0)))
    secrets = made((4, key, 1, name), (4, F.regexp_replace(F.base64(F.unhex(key)), "=", ""), 1, name), (4, F.upper(F.substring(key, 1, 24)), 1, name), (4, key, 0), (4, F.concat(F.lit("id-"), key), 0), (4, word, 0, name), (4, F.substring(word, 1, 9), 0, name), (4, F.substring(F.concat(d, F.lit("12345678")), 1, 8), 0, name), (4, F.repeat(word, 4), 0))
    failed = F.array(F.struct(k.alias("k"), m.alias("m"), F.lit(0).alias("label"), left.alias("l")))
    every = F.when(F.col("form") == 1, failed).otherwise(F.concat(rows, secrets))
    flat = spans.select("r", F.xxhash64("m").alias("h"), F.inline(every))
    return flat.select("k", "label", (F.pmod("h", F.lit(4)) == 0).alias("aside"), features(F.col("k"), F.col("m"), F.col("l"), F.col("r")).alias("x"))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list[dict[str, list]]:
    """Trees for logistic loss by second-order boosting, each full: inner nodes (feature f, cut c) and leaves v, in heap order."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    total, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        pull, weight = y - p, p * (1 - p)
        inner, node = 2**depth - 1, np.zeros(len(y), dtype=np.int64)
        f, c = [0] * inner, [1e300] * inner
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, 0, 1e300)
            whole = pull[rows].sum() ** 2 / (weight[rows].sum() + 1)
            for j, edges in enumerate(cuts):
                n = len(edges) + 1
                b = bins[j, rows]
                g, h = (np.cumsum(np.bincount(b, w[rows], n))[:-1] for w in (pull, weight))
                if not len(g):
                    continue
                gain = g**2 / (h + 1) + (pull[rows].sum() - g) ** 2 / (weight[rows].sum() - h + 1) - whole
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, float(edges[i]))
            f[at], c[at] = best[1], best[2]
            node[rows] = 2 * at + 1 + (x[rows, best[1]] > best[2])
        leaf = node - inner
        g, h = (np.bincount(leaf, w, inner + 1) for w in (pull, weight))
        v = rate * g / (h + 1)
        total += v[leaf]
        out.append({"f": f, "c": c, "v": v.tolist()})
    return out


def tree_scores(trees: list[dict[str, list]], x: np.ndarray) -> np.ndarray:
    """The sums that the SQL expression gives."""
    total = np.zeros(len(x))
    for t in trees:
        f, c, node = np.array(t["f"]), np.array(t["c"]), np.zeros(len(x), dtype=np.int64)
        while (node < len(f)).any():
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
        total += np.array(t["v"])[node - len(f)]
    return total


def score_sql(trees: list[dict[str, list]], x: str) -> str:
    """The sum of the leaves that the array x reaches, as SQL; the trees are one literal."""
    literal = f"from_json('{json.dumps(trees)}', 'array<struct<f:array<int>,c:array<double>,v:array<double>>>')"
    levels = ", ".join("0" for _ in range(len(trees[0]["f"]).bit_length()))
    return f"aggregate({literal}, 0D, (a, t) -> a + t.v[aggregate(array({levels}), 0, (n, z) -> 2 * n + 1 + CAST({x}[t.f[n]] > t.c[n] AS INT)) - {len(trees[0]['f'])}])"


def fit(found: DataFrame) -> tuple[list[dict[str, list]], dict[int, float]]:
    """The trees, and the least sum of each kind that is selected, from the candidates of all documents (column __cand)."""
    real = found.where("size(__cand) > 0").select(F.inline("__cand")).where("form > 0")
    # Copies of a span, however many, are one span.
    distinct = real.groupBy("k", "form", "m").agg(F.min(F.struct(F.xxhash64("l", "r"), "l", "r")).alias("c")).select("k", "form", "m", "c.l", "c.r", F.concat("k", "form").alias("group"))
    chosen = stratified(distinct, "group", BOUND).select("k", "m", "l", "r", "form")
    rows = examples(chosen.union(made_spans(found.sparkSession).withColumn("form", F.lit(2)))).collect()
    rows.sort()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["label"]) for r in rows])
    kind, aside = np.array([r["k"] for r in rows]), np.array([r["aside"] for r in rows])
    trees = boost(x[~aside], y[~aside])
    scores = tree_scores(trees, x[aside])
    limits = {}
    for k in range(len(KINDS)):
        mine = kind[aside] == k
        order = np.argsort(-scores[mine], kind="stable")
        value, right = scores[mine][order], np.cumsum(y[aside][mine][order])
        ends = np.append(value[1:] < value[:-1], True)[: len(value)]
        good = np.flatnonzero(ends & (right >= PRECISION * np.arange(1, len(value) + 1)))
        # Half way to the next lower score, so that forms a little unlike the ones kept aside are on the right side.
        limits[k] = max(float(value[good[-1] : good[-1] + 2].mean()), 0.0) if len(good) else float("inf")
    return trees, limits


def propose(docs: DataFrame) -> DataFrame:
    """docs and __cand, all candidates; null for texts without any."""
    text = F.coalesce("text", F.lit(""))
    # One look decides whether a text can hold anything at all; most can't.
    return docs.withColumn("__cand", F.when(text.rlike(ANY), candidates(text)))


def select_spans(found: DataFrame, model: tuple[list[dict[str, list]], dict[int, float]]) -> DataFrame:
    """found with __base and __spans as arrays of struct<k, s, e>, by kind and start; __spans holds base and what is added."""
    trees, limits = model
    place = lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"))
    # Of the proposals and failed matches each place counts once; what a base span covers whole is left out: events in
    # order of start, base spans before proposals, against the running greatest end of the base spans.
    events = F.array_sort(F.array_distinct(F.transform("__cand", lambda c: F.struct(c["s"].alias("s"), F.when(c["form"] == 2, 0).otherwise(1).alias("late"), c["e"].alias("e"), c["k"].alias("k"), c["m"].alias("m"), c["l"].alias("l"), c["r"].alias("r")))))
    reach = running(F.transform("__events", lambda x: F.when(x["late"] == 0, x["e"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
    open_ = F.filter(F.zip_with("__events", reach, lambda x, r: F.when((x["late"] == 1) & (x["e"] > r), x)), lambda x: x.isNotNull())
    described = F.transform(open_, lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), features(c["k"], c["m"], c["l"], c["r"]).alias("x")))
    found = found.withColumns({"__base": F.transform(F.filter("__cand", lambda c: c["form"] == 2), place), "__events": F.when(F.exists("__cand", lambda c: c["form"] < 2), events)})
    found = found.withColumn("__open", F.when(F.size("__events") > 0, described))
    limit = " ".join(f"WHEN {k} THEN double('{v}')" for k, v in limits.items())
    added = F.expr(f"transform(filter(__open, c -> {score_sql(trees, 'c.x')} >= CASE c.k {limit} END), c -> named_struct('k', c.k, 's', c.s, 'e', c.e))")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    found = found.withColumn("__base", F.coalesce("__base", none))
    return found.withColumn("__spans", F.when(F.size("__open") > 0, F.array_distinct(F.array_sort(F.concat("__base", added)))).otherwise(F.col("__base"))).drop("__cand", "__events", "__open")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every document."""
    found = cut(propose(docs.select("doc_id", "text")).drop("text"))
    return select_spans(found, fit(found)).select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans redacted; columns as they come, a null text stays null.

    Documents and their candidates are written once, so that the patterns pass over each text once. What a row has beside
    its text travels as one struct, so no column of docs can clash with what is computed.
    """
    rest = [docs[f"`{c}`"] for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    found = cut(propose(docs.select(F.struct(*rest).alias("row"), F.col("text"))))
    spans = select_spans(found, fit(found))
    spans = spans.withColumn("__runs", F.when(F.size("__spans") > 0, runs(F.col("__spans"))))
    end = F.array_max(F.transform("__spans", lambda c: c["e"]))
    clean = F.concat(redacted(F.col("text"), F.col("__runs")), F.substring("text", end + 1, F.length("text")))
    clean = F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))
    return spans.select(*(clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def named(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def counts_and_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many they are."""
    n = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    return found.select("doc_id", *n, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _of_kind(i: int):
    return lambda c: c["k"] == i


def runs(spans: Column) -> Column:
    """array<struct<from, to, k>>: for each span, or run of overlapping spans, the end of what stands before, its start, its first kind."""
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    # Each span with the greatest end before it; a span that starts there or later begins a run.
    reach = running(F.transform(ordered, lambda c: c["e"]), 0, lambda x, y: F.greatest(x, y))
    return F.filter(F.zip_with(ordered, reach, lambda c, r: F.struct(r.alias("from"), c["s"].alias("to"), c["k"].alias("k"))), lambda c: c["to"] >= c["from"])


def redacted(text: Column, runs: Column) -> Column:
    """The text up to the last run, each run replaced by its kind in angle brackets.

    Blocks of runs take their part of the text first, so that no substring is counted off from the start each time.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def block(b: Column) -> Column:
        part = F.slice(runs, b * BLOCK + 1, F.lit(BLOCK))
        low, high = F.get(part, F.lit(0))["from"], F.element_at(part, -1)["to"]
        return once(F.substring(text, low + 1, high - low), lambda t: F.array_join(F.transform(part, lambda c: F.concat(F.substring(t, c["from"] - low + 1, c["to"] - c["from"]), F.get(names, c["k"]))), ""))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / BLOCK).cast("int")), block), "")
