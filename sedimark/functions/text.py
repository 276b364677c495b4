"""Scalar functions of texts, as Columns that stay inside code generation."""

from __future__ import annotations

import functools
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker words of each kind, in order of precedence.
PRINCIPLE = ("should", "must", "always", "never", "principle", "rule")
CASE = ("example", "for instance", "case", "scenario")
TERM = ("definition", "means", "refers to", "is a", "is an")
# Character ranges that count as ideographs in the two token estimates.
CJK_NARROW = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
CJK_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{FF00}-\x{FFEF}]"
# Characters that hide in a line.
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
DIRECTIONAL = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"
CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
# Phrases that try to steer a model.
INJECTION = (
    r"\bignore\s+(?:previous|above|all|prior)\s+instructions?\b",
    r"\bdisregard\s+(?:previous|above|all|prior)\s+instructions?\b",
    r"\byou\s+are\s+(?:now|a|an)\b",
    r"\b(?:system|assistant|user)\s*:",
    r"<\|im_start\|>",
    r"\[/INST\]",
    r"\bnew\s+instructions?\s*:",
    r"\bforget\s+(?:everything|all|previous)\b",
    r"\bact\s+as\s+(?:a|an)\b",
)
INJECTION_ZH = (
    r"忽略(?:上述|以上|前面|之前|所有)?(?:指令|指示|规则|约束)",
    r"无视(?:上述|以上|前面|之前|所有)?(?:指令|指示|规则|约束)",
    r"你现在是",
    r"系统提示",
    r"角色设定",
    r"新(?:指令|指示)\s*[：:]",
    r"忘掉(?:一切|所有|前面|之前)",
    r"扮演(?:一个|一名)?.{0,20}(?:助手|系统|AI|模型)",
)

#: White space of ASCII.
ASCII_SPACE = " \t\n\x0b\f\r"

#: The English phrases as one pattern; cases, white space and the borders of words are those of Unicode.
STEERING = "(?iU)" + "|".join(INJECTION)


def trimmed(t: Column) -> Column:
    """Without leading and trailing white space of any kind (trim() knows spaces only)."""
    return F.btrim(t, F.lit(ASCII_SPACE))


def is_ascii(t: Column) -> Column:
    """Whether each character takes one byte; no search."""
    return F.octet_length(t) == F.length(t)


def source_id(t: Column) -> Column:
    """The first 12 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(t, 256), 1, 12)


def ranges(wanted) -> str:
    """The code points for which wanted(character) holds, as ranges of a regex class that Java and RE2 both read."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        hit = c <= sys.maxunicode and wanted(chr(c))
        if hit and first is None:
            first = c
        elif not hit and first is not None:
            out.append(f"\\x{{{first:X}}}-\\x{{{c - 1:X}}}")
            first = None
    return "".join(out)


@functools.cache
def combining_class() -> str:
    """A regex class of the characters with a combining class other than 0."""
    return f"[{ranges(lambda c: unicodedata.combining(c) != 0)}]"


@functools.cache
def combining() -> str:
    """All characters with a combining class other than 0."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))


@functools.cache
def foldings() -> dict[str, str]:
    """Lower-case characters that fold to something else."""
    return {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c == c.lower() and c != c.casefold()}


def casefold(t: Column) -> Column:
    """Full case folding: lower case, in which the characters of foldings() are folded further. ASCII texts skip the search; characters that fold to several but the sharp s have steps only in texts with one of them."""
    one = {k: v for k, v in foldings().items() if len(v) == 1}
    more = {k: v for k, v in foldings().items() if len(v) > 1 and k != "\u00df"}
    low = F.lower(t)
    first = F.replace(F.replace(low, F.lit("\u00df"), F.lit("ss")), F.lit("\u00b5"), F.lit("\u03bc"))  # of the first 256 characters only these fold further
    spread = F.translate(F.replace(low, F.lit("\u00df"), F.lit("ss")), "".join(one), "".join(one.values()))
    rare = spread
    for k, v in more.items():
        rare = F.replace(rare, F.lit(k), F.lit(v))
    has_more = F.length(F.translate(low, "".join(more), "")) < F.length(low)  # a table of characters is looked up faster than a class of a pattern
    return F.when(is_ascii(t), low).when(~low.rlike(r"[^\x00-\xFF]"), first).when(has_more, rare).otherwise(spread)


def has_any(t: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains any of the words as a substring."""
    return once(t, lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words]))


def kind(t: Column) -> Column:
    """principle, case, term or else technique, by substring markers in this order."""
    has = lambda low, words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    named = once(F.lower(t), lambda low: F.when(has(low, PRINCIPLE), "principle").when(has(low, CASE), "case").when(has(low, TERM), "term").otherwise("technique"))
    return F.coalesce(named, F.lit("technique"))


def confidence(t: Column) -> Column:
    """Longer texts count as surer: under 20, 100 and 500 characters and above."""
    n = F.length(t)
    return F.when(n < 20, 0.3).when(n < 100, 0.5).when(n < 500, 0.7).otherwise(0.8)


def heading_level(t: Column) -> Column:
    """Number of leading # up to 6; without any, 1 for a line of at most 80 characters that has no closing punctuation, else 0."""
    marks = F.length(F.regexp_extract(t, "^(#*)", 1))
    plain = (F.length(t) <= 80) & ~t.rlike(r"[.!?,;:]$")
    return F.when(marks.between(1, 6), marks).when(marks > 6, 0).otherwise(F.when(plain, 1).otherwise(0)).cast("long")


def tokens(t: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def shingles(t: Column) -> Column:
    """Distinct runs of three tokens; a token is a Latin word or one ideograph. Empty below three tokens."""
    words = F.regexp_extract_all(casefold(t), F.lit(r"([a-z0-9]+|[\x{3400}-\x{9FFF}])"), F.lit(1))
    runs = lambda w: F.when(F.size(w) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat(w[i], F.lit("␟"), w[i + 1], F.lit("␟"), w[i + 2])))
    )
    return F.transform(F.array(words), runs)[0]


def normalized(t: Column) -> Column:
    """Case-folded, runs of anything but letters, digits and _ as one space, trimmed."""
    return F.trim(F.when(is_ascii(t), F.regexp_replace(F.lower(t), "[^a-z0-9_]+", " ")).otherwise(F.regexp_replace(casefold(t), r"[^\p{L}\p{N}_]+", " ")))


def effective_words(t: Column) -> Column:
    """White-space words of the text without ideographs, plus two words for every three ideographs. Texts without ideographs skip these steps."""
    cjk = F.length(F.regexp_replace(t, CJK_WIDE.replace("[", "[^", 1), ""))
    count = lambda x: F.when(trimmed(x) == "", 0).otherwise(F.size(F.split(trimmed(x), r"\s+")))
    return F.when(~is_ascii(t) & t.rlike(CJK_WIDE), count(F.regexp_replace(t, CJK_WIDE, "")) + F.ceil(cjk / 1.5)).otherwise(count(t)).cast("long")


def token_estimate_chunk(t: Column) -> Column:
    """Half a token for an ideograph and a quarter for another character, each sum rounded up."""
    cjk = F.when(t.rlike(CJK_NARROW), F.length(F.regexp_replace(t, CJK_NARROW.replace("[", "[^", 1), ""))).otherwise(0)
    return (F.floor((cjk + 1) / 2) + F.floor((F.length(t) - cjk + 3) / 4)).cast("long")


def token_estimate_budget(t: Column) -> Column:
    """The estimate that budgets use: wider ranges of ideographs, 1.5 to a token, and no characters with a combining class. ASCII texts skip both searches."""
    bare = F.when(t.rlike(r"\p{M}"), F.translate(t, combining(), "")).otherwise(t)
    cjk = F.when(t.rlike(CJK_WIDE), F.length(F.regexp_replace(bare, CJK_WIDE.replace("[", "[^", 1), ""))).otherwise(0)
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.ceil(cjk / 1.5) + F.ceil((F.length(bare) - cjk) / 4)).otherwise(F.ceil(F.length(t) / 4)).cast("long")


def _may_steer(t: Column) -> Column:
    """What any text with a phrase of INJECTION has, found by plain searches in lower case; characters that are equal to s, k or i in any case count as these."""
    folded = reduce(lambda x, c: F.replace(x, F.lit(c[0]), F.lit(c[1])), ("\u017fs", "\u212ak", "\u0131i", "\u0130i"), t)

    def found(x: Column) -> Column:
        has = x.contains
        are = has("you") & has("are") & x.rlike(r"(?U)you\s+are\s+(?:now|a)")
        role = has(":") & (has("system") | has("assistant") | has("user"))
        return has("instruction") | are | role | has("<|im_start|>") | has("[/inst]") | has("forget") | (has("act") & x.rlike(r"(?U)act\s+as\s+a"))

    return once(F.when(is_ascii(t), F.lower(t)).otherwise(F.lower(folded)), found)


def steers(t: Column) -> Column:
    """Whether a text has an English steering phrase."""
    return _may_steer(t) & t.rlike(STEERING)


def injection_code(line: Column) -> Column:
    """The first kind of steering phrase in a line, or null."""
    return F.when(steers(line), "injection.en").when(~is_ascii(line) & line.rlike("|".join(INJECTION_ZH)), "injection.zh")


def suspicious(t: Column) -> Column:
    """Whether a text can have a line with a steering phrase or hidden character: searched over the whole text, so that others need not be split, and slowly only where plain searches leave it open."""
    first = "".join(p[0] for p in INJECTION_ZH)
    wide = ~is_ascii(t) & t.rlike(f"[{first}{ZERO_WIDTH[1:-1]}{DIRECTIONAL[1:-1]}]") & t.rlike("|".join([*INJECTION_ZH, ZERO_WIDTH, DIRECTIONAL]))
    return t.rlike(CONTROL) | wide | steers(t)


def link_code(url: Column) -> Column:
    """fail.scheme for data and javascript, warn.scheme for any scheme but https, warn.internal for internal hosts, else ok."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    internal = host.isin("localhost", "0.0.0.0") | host.rlike(r"^(?:127\.|10\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    return F.when(scheme.isin("data", "javascript"), "fail.scheme").when(internal, "warn.internal").when((scheme != "") & (scheme != "https"), "warn.scheme").otherwise("ok")


# Claims that need a qualification, and what may stand right before one to negate it.
CLAIMS = (
    ("guarantee", r"保证(?:了|会|能|可以|有效|成功|持续|实现)?|必然(?:会|能|导致)?|一定(?:会|能|可以|有效|成功)|(?:永远|绝对)(?:不会|有效|正确)?"),
    ("causality", r"证明(?:了|其|这|该)?|说明(?:了|其|这|该)?.{0,12}(?:负责|导致|决定)"),
    ("guarantee", r"(?i)\b(?:guarantee(?:s|d)?|ensure(?:s|d)?|always|never\s+fails)\b"),
    ("causality", r"(?i)\b(?:prove(?:s|d)?|demonstrate(?:s|d)?)\b"),
)
NEGATION = ("不", "未", "无", "并不", "并未", "does not ", "do not ", "doesn't ", "don't ", "not ")
# Fixed value: how many characters before a claim are searched for its negation.
NEGATION_REACH = 12
# What is masked in text for the outside.
MASKS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"(?:/home|/Users)/[A-Za-z0-9._-]+", r"\b[0-9a-f]{32,}\b")

# Credentials and absolute paths in messages; white space is that of Unicode.
SECRET_VALUE = r"(?i)(?:sk|key|token|secret)[-_][A-Za-z0-9._~-]{6,}"
ABSOLUTE_PATH = r"""(?:[A-Za-z]:[\\/]|/)[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"']+"""


#: Elements of an array that running() folds at a time; a fold that grows an array costs the square of this, not of the array.
CHUNK = 64


def once(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step, start: Column) -> Column:
    """The folds of all prefixes of an array of numbers by an associative step: chunk by chunk, then with the folds of the chunks before."""
    grow = lambda a, v: once(step(a.at, v), lambda x: F.struct(x.alias("at"), F.concat(a.out, F.array(x)).alias("out")))
    kind = "bigint"
    prefixes = lambda xs: F.aggregate(xs, F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), grow, lambda a: a.out)

    def carried(parts: Column) -> Column:
        before = F.concat(F.array(start.cast(kind)), prefixes(F.transform(parts, lambda p: F.element_at(p, -1))))
        return once(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: step(b[i], x)))))

    def chunked(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: prefixes(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))
        return F.when(F.size(v) > 0, once(chunks, carried)).otherwise(F.array().cast(f"array<{kind}>"))

    return once(values, chunked)  # a chunk must not compute the whole array anew


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0))


def matches(t: Column, pattern: str) -> Column:
    """start and end (code points from 0, end exclusive) and match of each match of pattern. Gaps and matches alternate, so the sums of their lengths say where they lie."""
    flags, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    found, gaps = F.regexp_extract_all(t, F.lit(f"{flags}({rest})"), F.lit(1)), F.split(t, pattern, -1)
    both = once(found, lambda m: F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda x, g: F.struct(x.alias("match"), F.length(x).cast("bigint").alias("long"), (F.length(x) + F.length(g)).cast("bigint").alias("both"))))

    def placed(parts: Column) -> Column:
        ends = running_sum(F.transform(parts, lambda p: p.both))
        return once(ends, lambda e: F.transform(parts, lambda p, i: F.struct((e[i] - p.long).alias("start"), e[i].alias("end"), p.match.alias("match"))))

    return F.when(t.rlike(pattern), once(both, placed)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>"))


def match_starts(t: Column, pattern: str) -> Column:
    """Offsets from 0 of the matches of pattern."""
    return F.transform(matches(t, pattern), lambda m: m.start.cast("int"))


def claim_starts(line: Column, pattern: str) -> Column:
    """Offsets of the claims in a line that no negation ends right before, within NEGATION_REACH characters."""
    before = lambda at: casefold(F.substring(line, F.greatest(at - NEGATION_REACH, F.lit(0)) + 1, F.least(at, F.lit(NEGATION_REACH))))
    negated = f"(?:{'|'.join(NEGATION)})$"
    return F.filter(match_starts(line, pattern), lambda at: ~before(at).rlike(negated))


def claim_codes(line: Column) -> Column:
    """The code of every claim in a line, by pattern and place."""
    named = lambda code: lambda at: F.struct(F.lit(code).alias("code"), at.alias("at"))
    return F.concat(*[F.transform(claim_starts(line, pattern), named(code)) for code, pattern in CLAIMS])


def redacted(t: Column) -> Column:
    """The text with credentials and absolute paths taken out."""
    return F.regexp_replace(F.regexp_replace(t, SECRET_VALUE, "[REDACTED]"), ABSOLUTE_PATH, "[PATH]")


def masked(t: Column) -> Column:
    """The text with addresses, home folders and long digests masked."""
    for m in MASKS:
        t = F.regexp_replace(t, m, "[masked]")
    return t


def size_label(n: Column) -> Column:
    """Bytes as whole B, KB or MB, rounded down."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.floor(n / 1048576).cast("string"), F.lit(" MB")))


def substantive(line: Column) -> Column:
    """Whether a line is more than blank, a heading, a rule or a comment."""
    return line.rlike(r"\S") & ~line.rlike(r"^\s*(?:#|---|\*\*\*|<!--)")


def unique_words(t: Column) -> Column:
    """All words of a text between spaces and line ends, lower-cased, once each in the order of first use."""
    return F.array_distinct(F.filter(F.transform(F.split(t, "[\n ]"), lambda w: F.lower(F.trim(w))), lambda w: w != ""))
