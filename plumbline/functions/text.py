"""Model answers and expressions parsed into columns.

Everything here is a built-in expression over text columns (Java regex, JSON and array
functions): no row-wise Python, whole texts, any number of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions.hashing import seeded_int

# ---- fixed values: phrases, word lists and patterns the results depend on ------------------

REFUSAL_PHRASES = ("i can't help", "i cannot help", "i'm unable to", "i am unable to",
                   "i can't assist", "i cannot assist", "as an ai")
NONE_PATTERNS = ("none", "no such object", "not present")
BOX_JSON = r'(?s)\{[^{}]*"bbox_2d"[^{}]*\}'
NUMBER = r"-?\d+(?:\.\d+)?"
FOUR_NUMBERS = r"(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)[\s,]+(-?\d+(?:\.\d+)?)"
POINT_TAG = r'<(?:points|tracks)[^>]*?coords="([0-9\t:;, .]+)"\s*/?>'
POINT_TRIPLE = r"([0-9]+) ([0-9]{3,4}) ([0-9]{3,4})"
YES_WORDS, NO_WORDS = ("yes", "yeah", "yep"), ("no", "nope")
NUMBERED_VERDICT = r"(?imd)^\s*\**\s*(\d+)\s*[.:)\-]+\s*\**\s*(yes|no|unclear)\b"
NUMBERED_VERDICT_SEEN = r"(?imd)^\s*\**\s*(\d+)\s*[.:)\-]+\s*\**\s*(yes|no|unclear)\b\s*\|?\s*(.*?)\s*$"
NUMBERED_LINE = r"^\s*(\d+)\s*[:.)\-]\s*(.+?)\s*$"
LINE_BREAK = r"[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029](?:(?<=\r)\n)?"
QUOTES = "\"'“”‘’`"
#: All white space of Unicode.
WHITE = "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHANGED_LINE = r"(?i)CHANGED:\s*(.+?)\s*->\s*(.+)$"
OLD_NEW_LINE = r"(?imd)^(OLD|NEW[123]):\s*(.+?)\s*$"
DESCRIPTION_BLOCK = r"(?s)<description>\s*(.*?)\s*</description>"
DETAILS_BLOCK = r"(?s)<details>\s*(.*?)\s*</details>"
DETAIL_LINE = r"(?md)^\s*(\d+)[.:)]\s*(.+?)\s*$"
VERSION_BLOCK = r'(?s)<version\s+kind="([ABC])"\s+detail="(\d+)"\s*>\s*(.*?)\s*</version>'
CONDITIONS_BLOCK = r"(?is)<conditions>(.*?)</conditions>"
CONDITION_LINE = r"^\s*(\d+)\s*[.):]\s*(.+?)\s*$"
OBJECT_BLOCK = r'(?is)<object\s+id="?(\d+)"?\s+bbox="?\s*\[?\s*([-\d.,\s]+?)\s*\]?\s*"?\s*>(.*?)</object>'
CELL = (r"(?id)(\d+)\s*:\s*(yes|no|unclear)\b\s*(?:\(\s*seen\s*:\s*([^)]*)\)|(?:[—–]|-(?!>))+\s*([^;\n<]*?)"
        r"(?=\s*(?:;|->|\n|</object>|$)))?")
ANSWER_BLOCK = r"(?is)<answer>(.*?)</answer>"
TOOL_BLOCK = r"(?is)<tool_call>(.*?)</tool_call>"
FOUR_IN_BRACKETS = (r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]")
AUDIT_BLOCK, VERDICT_BLOCK = r"(?is)<audit>(.*?)</audit>", r"(?is)<verdict>(.*?)</verdict>"
AUDIT_LINE = r"(?imd)^\s*(\d+)\.\s*(?:\[(\w+)\]\s*)?(.*?)\s*\|\s*seen:\s*(.*?)\s*\|\s*(match|mismatch|unsure)\b"
AUDIT_TYPES = ("color", "text", "part", "state", "count", "material", "shape", "relation")
PROMPT_HEADER = r"^#\s*([a-z_]+):\s*(.*)$"
RELATIONAL_CUE = (r"\b(that|which|who|on|in|at|under|above|behind|next|near|beside|between|to|of|with|"
                  r"left|right|top|bottom|middle|centre|center|front|back)\b")
ARTICLES = ("the ", "a ", "an ")
CLAUSE_RELATION = (r"\b(left|right|front|behind|back|next to|beside|between|near|above|below|under|over|on top of|center|centre|middle|"
                   r"foreground|background|closest|farthest|nearest|leftmost|rightmost|second from|first from|row|"
                   r"edge of the (?:frame|image)|side of the (?:frame|image))\b")
CLAUSE_TEXT = r"\"|'|\b(text|reads?|says?|written|letter(?:s|ing)?|word|number|digit|logo|label|sign|printed|writes?)\b|\d"
CLAUSE_TEXT_NOT = r"\b(one|two|three|four)\b"
CLAUSE_COLOR = (r"\b(red|blue|green|yellow|orange|purple|pink|brown|black|white|gr[ae]y|silver|gold(?:en)?|beige|tan|navy|teal|maroon|"
                r"dark|light|pale|bright|striped|checkered|plaid|colou?r)\b")
CLAUSE_COUNT = r"\b(one|two|three|four|five|six|seven|eight|nine|ten|single|pair|several|multiple|many|no|only|both|\d+)\b\s+\w+"
CLAUSE_MATERIAL = (r"\b(wooden|wood|metal(?:lic)?|plastic|glass|leather|fabric|cloth|stone|brick|concrete|paper|cardboard|rubber|steel|"
                   r"iron|fur|wool|denim|ceramic)\b")
CLAUSE_STATE = (r"\b(open|closed|sitting|standing|lying|walking|running|holding|carrying|wearing|looking|facing|parked|moving|turned|"
                r"raised|folded|bent|leaning|resting|hanging|tilted|broken|wet|dry|lit|on|off)\b")
CLAUSE_SHAPE = (r"\b(round|square|rectangular|oval|circular|triangular|curved|straight|pointed|flat|tall|short|long|wide|narrow|thin|"
                r"thick|small|large|big|tiny|huge)\b")
LINE_CATEGORIES = (
    ("relation", r"\b(left|right|behind|front|next to|beside|near|between|above|below|under|over|on top|closest|farthest|leftmost|"
                 r"rightmost|middle|center|background|foreground|nearest|upper|lower)\b"),
    ("text", r"(\"|'|\btext\b|\breads\b|\bwritten\b|\blogo\b|\bsign\b|\bletter|\bnumber\b)"),
    ("count/order", r"\b(\d+|one|two|three|four|five|first|second|third|fourth|row|pair)\b"),
    ("color", r"\b(red|blue|green|yellow|white|black|gray|grey|brown|orange|pink|purple|silver|gold|dark|light|beige|tan)\b"),
    ("action/pose", r"\b(holding|wearing|sitting|standing|walking|looking|carrying|riding|lying|leaning|hanging|raised|bent)\b"),
)
NORM_DROP = (r"\b(a|an|the|is|are|it|its|with|of|in|on|and|has|have|this|that|there|very|some|slightly)\b")
NEGATIONS = ("not", "no", "none", "without", "instead", "rather", "than", "different", "missing", "absent", "visible",
             "unclear", "cannot", "can", "see", "seen", "tell")
ALIGN_STOP = ("the", "a", "an", "is", "has", "of", "and", "with", "that", "its", "it")
PARAPHRASE_STOP = ("the", "a", "an", "is", "are", "has", "have", "with", "of", "in", "on", "and", "its", "it", "that",
                   "this", "to", "at", "by", "from")
CONTRAST = r"(?iU)\bnot\b|\binstead\b|\brather\b|\bno\b\s+\w+|\bwithout\b|\bmissing\b|\babsent\b"
COLOUR_SWAP = {"red": "blue", "blue": "red", "green": "red", "yellow": "blue", "purple": "yellow", "pink": "green",
               "brown": "blue", "black": "white", "white": "black", "gray": "red", "grey": "red"}
WORD_SWAP = {"left": "right", "right": "left", "top": "bottom", "bottom": "top", "upper": "lower", "lower": "upper",
             "front": "back", "back": "front", "first": "second", "second": "third", "third": "second",
             "1st": "2nd", "2nd": "3rd", "3rd": "2nd"}
EDIT_KIND = {"left": "left/right", "right": "left/right", "top": "vertical", "bottom": "vertical", "upper": "vertical",
             "lower": "vertical", "front": "depth", "back": "depth", "first": "ordinal", "second": "ordinal",
             "third": "ordinal", "1st": "ordinal", "2nd": "ordinal", "3rd": "ordinal"}
FLIP_SKIP = (r"(?i)black and white|white and black|back to|backs? of|right (?:hand|arm|leg|foot|side up|now)|"
             r"left (?:hand|arm|leg|foot)|top of the|on top of|in front of")
ORDINAL_WORDS = ("first", "second", "third", "fourth", "fifth", "leftmost", "rightmost", "topmost", "bottommost",
                 "from the left", "from the right", "from the top", "from the bottom", "closest", "nearest", "farthest")
HEAD_NOUNS = {"Land vehicle": "vehicle", "Sports equipment": "piece of sports equipment", "Tableware": "piece of tableware",
              "Furniture": "piece of furniture", "Mammal": "animal", "Food": "food item", "Snack": "snack", "Coffee cup": "cup"}
REASON_WORDS = 12

# ---- small pieces ---------------------------------------------------------------------------

_NULL_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def let_all(fn, **values: Column) -> Column:
    """``fn(struct)`` over several values computed once."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), fn)


def strip(t: Column) -> Column:
    """Trim every kind of white space, not only blanks. Looks at the ends of a text only."""
    return F.btrim(t, F.lit(WHITE))


def strip_quotes(t: Column) -> Column:
    cls = re.escape(QUOTES).replace('"', '\\"')
    return F.regexp_replace(t, f"^[{cls}]+|[{cls}]+$", "")


def bare(t: Column) -> Column:
    """``strip_quotes(strip(t))``. A stripped text ends in no line break, so its ends are all there is to look at."""
    return F.btrim(strip(t), F.lit(QUOTES))


def lines(t: Column) -> Column:
    return F.split(t, LINE_BREAK)


def has_text(t: Column) -> Column:
    return F.coalesce(F.length(strip(t)) > 0, F.lit(False))


def quoted(t: Column) -> Column:
    """A literal text as a regex."""
    return F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def whole_word(t: Column) -> Column:
    return F.concat(F.lit(r"(?iU)(?<!\w)"), quoted(t), F.lit(r"(?!\w)"))


def literal_replace(t: Column, pattern: Column, replacement: Column) -> Column:
    """Regex replace where the replacement is plain text (``$`` and ``\\`` mean themselves)."""
    return F.replace(F.regexp_replace(t, pattern, F.lit("\u0001")), F.lit("\u0001"), replacement)


def words(t: Column, stop=()) -> Column:
    """Distinct lower-case ASCII words without stop words."""
    w = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.array_except(w, F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(w)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two word arrays; 0 when both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def match_groups(t: Column, pattern: str, names: dict[str, int]) -> Column:
    """All matches of a pattern as an array of structs, one field per group."""
    t = F.coalesce(t, F.lit(""))
    arrays = [F.regexp_extract_all(t, F.lit(pattern), g).alias(n) for n, g in names.items()]
    return F.arrays_zip(*arrays)


def line_groups(t: Column, pattern: str, names: dict[str, int]) -> Column:
    """The same, with the text searched once: each match is then cut into its groups by one replacement. For patterns
    whose groups hold no line feed and that look at nothing outside the match but ends of lines and words."""
    found = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0))
    cut = F.lit("\n".join(f"${g}" for g in names.values()))
    return F.transform(found, lambda m: let(F.split(F.regexp_replace(m, F.lit(pattern), cut), "\n"), lambda g: F.struct(
        *[F.get(g, F.lit(i)).alias(n) for i, n in enumerate(names)])))


# ---- answers --------------------------------------------------------------------------------


def looks_like_refusal(t: Column) -> Column:
    return F.lower(t).rlike("|".join(re.escape(p) for p in REFUSAL_PHRASES))


def matches_none(t: Column, patterns=NONE_PATTERNS) -> Column:
    """An abstain phrase on letter boundaries ("none" does not fire on "nonetheless")."""
    use = [p.lower() for p in patterns if p and p != "PIN_REQUIRED"]
    if not use:
        return F.lit(False)
    return F.lower(t).rlike("(?<![a-z])(?:" + "|".join(re.escape(p) for p in use) + ")(?![a-z])")


def first_json_box(t: Column) -> Column:
    """struct<found, is_null, four> of the first JSON object that mentions the key."""
    def read(v):
        value = F.try_variant_get(v, "$.bbox_2d", "variant")
        numbers = F.try_variant_get(v, "$.bbox_2d", "array<double>")
        four = F.when((F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull()), numbers)
        return F.struct((v.isNotNull() & value.isNotNull()).alias("found"), F.coalesce(F.is_variant_null(value), F.lit(False)).alias("is_null"), four.alias("four"))

    return let(F.try_parse_json(F.regexp_extract(t, BOX_JSON, 0)), read)


def last_four_numbers(t: Column) -> Column:
    runs = F.regexp_extract_all(t, F.lit(FOUR_NUMBERS), 0)
    last = F.try_element_at(runs, F.lit(-1))
    return F.when(last.isNotNull(), F.transform(F.regexp_extract_all(last, F.lit(NUMBER), 0), lambda x: x.cast("double")))


def parse_box_answer(t: Column, w, h, convention: Column | None = None, sent_w=None, sent_h=None, none_patterns=()) -> Column:
    """struct<output_type, parse_ok, box, n_boxes, note> of one raw answer, in original pixels."""
    t = F.coalesce(t, F.lit(""))
    conv = F.lit("relative_1000") if convention is None else convention

    def place(s):
        numbers = (F.when(s["refusal"], None).when(s["js"]["found"], s["js"]["four"]).when(s["none"], None).otherwise(s["loose"]))
        return F.struct(*[s[k].alias(k) for k in ("refusal", "js", "none")],
                        G.clamp(G.to_original_pixels(G.box_of_array(numbers), conv, w, h, sent_w, sent_h), w, h).alias("px"), numbers.isNotNull().alias("boxed"))

    def judge(s):
        found, px, boxed = s["js"]["found"], s["px"], s["boxed"]
        degenerate = (G.width(px) <= 0) | (G.height(px) <= 0)
        note = (F.when(s["refusal"], "refusal").when(found & s["js"]["is_null"], "bbox_2d: null").when(found & s["js"]["four"].isNull(), "bbox_2d is not four numbers")
                .when(~found & s["none"], "none pattern").when(~boxed, "no bbox_2d and no four numbers").when(degenerate, "degenerate box")
                .when(found, "").otherwise("recovered from loose numbers"))
        kind = (F.when(s["refusal"], "refusal").when(found & s["js"]["is_null"], "none").when(found & s["js"]["four"].isNull(), "invalid")
                .when(~found & s["none"], "none").when(~boxed | degenerate, "invalid").otherwise("box"))
        return F.struct(kind.alias("output_type"), (kind != "invalid").alias("parse_ok"), F.when(boxed, px).alias("box"),
                        F.when(boxed, 1).otherwise(0).alias("n_boxes"), note.alias("note"))

    return let(let_all(place, refusal=looks_like_refusal(t), js=first_json_box(t), none=matches_none(t, none_patterns), loose=last_four_numbers(t)), judge)


def parse_point_answer(t: Column, w, h, none_patterns=()) -> Column:
    """struct<output_type, parse_ok, x, y, n_points, note> of a pointing answer (0..1000 frame)."""
    t = F.coalesce(t, F.lit(""))
    tags = F.regexp_extract_all(t, F.lit(POINT_TAG), 1)
    triples = F.flatten(F.transform(tags, lambda c: F.regexp_extract_all(c, F.lit(POINT_TRIPLE), 0)))
    sx, sy = G.dbl(w) / 1000.0, G.dbl(h) / 1000.0
    points = F.transform(triples, lambda s: F.struct((F.split(s, " ")[1].cast("double") * sx).alias("x"),
                                                     (F.split(s, " ")[2].cast("double") * sy).alias("y")))
    kept = F.filter(points, lambda p: p["x"].between(0, G.dbl(w)) & p["y"].between(0, G.dbl(h)))
    n, offered, tagged = F.size(kept), F.size(triples), F.size(tags) > 0
    refusal, none = looks_like_refusal(t), matches_none(t, none_patterns)
    kind = (F.when(refusal, "refusal").when(n == 1, "point").when(n > 1, "set").when(none, "none")
            .when(tagged & (offered == 0), "none").otherwise("invalid"))
    note = (F.when(refusal, "refusal").when(n >= 1, "").when(none, "none pattern").when(tagged & (offered == 0), "empty point list")
            .when(tagged, "all points outside the frame").otherwise("no points tag and no none pattern"))
    first = F.when(~refusal, F.try_element_at(kept, F.lit(1)))
    return F.struct(kind.alias("output_type"), (kind != "invalid").alias("parse_ok"), first["x"].alias("x"), first["y"].alias("y"),
                    F.when(refusal, 0).when(n >= 1, n).when(kind == "invalid", offered).otherwise(0).alias("n_points"), note.alias("note"))


def first_word(t: Column) -> Column:
    w = F.regexp_extract(F.lower(strip(t)), "[a-z]+", 0)
    return F.when(w != "", w)


def verdict_word(t: Column) -> Column:
    """yes / no / unclear / unparsed from the first word."""
    w = first_word(t)
    return (F.when(w.isin(*YES_WORDS), "yes").when(w.isin(*NO_WORDS), "no")
            .when(w.startswith("unclear"), "unclear").otherwise("unparsed"))


def yes_no(t: Column) -> Column:
    """true / false / null from the first word."""
    w = first_word(t)
    return F.when(w.isin(*YES_WORDS), True).when(w.isin(*NO_WORDS), False)


def _numbered(found: Column, n: Column, pick, missing: Column) -> Column:
    """Array 1..n: the first match with that number, else ``missing``."""
    def pos(f, k):
        return F.try_element_at(F.filter(f, lambda m: m["k"].try_cast("int") == k), F.lit(1))

    return let(found, lambda f: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: let(pos(f, k), lambda m: F.coalesce(pick(m), missing))))


def numbered_verdicts(t: Column, n) -> Column:
    """``k: yes/no/unclear`` lines to an array of n verdicts; first wins, missing = unparsed."""
    found = match_groups(t, NUMBERED_VERDICT, {"k": 1, "v": 2})
    return _numbered(found, G.num(n), lambda m: F.lower(m["v"]), F.lit("unparsed"))


def numbered_verdicts_seen(t: Column, n) -> Column:
    """The same lines with what was seen after a bar: array of struct<verdict, seen>."""
    found = match_groups(t, NUMBERED_VERDICT_SEEN, {"k": 1, "v": 2, "s": 3})
    blank = F.struct(F.lit("unparsed").alias("verdict"), F.lit("").alias("seen"))
    return _numbered(found, G.num(n), lambda m: F.when(m.isNotNull(), F.struct(
        F.lower(m["v"]).alias("verdict"), F.regexp_replace(strip(m["s"]), r"\.+$", "").alias("seen"))), blank)


def numbered_lines(t: Column, n) -> Column:
    """``k. text`` lines to an array of n texts, first wins, missing = null."""
    rows = F.transform(lines(F.coalesce(t, F.lit(""))), lambda x: F.struct(
        F.regexp_extract(x, NUMBERED_LINE, 1).alias("k"), F.regexp_replace(strip(F.regexp_extract(x, NUMBERED_LINE, 2)), '^"+|"+$', "").alias("s")))
    found = F.filter(rows, lambda r: r["k"] != "")
    return _numbered(found, G.num(n), lambda m: m["s"], F.lit(None).cast("string"))


# ---- tagged texts ---------------------------------------------------------------------------


def clean_line(t: Column) -> Column:
    """First line of a text without surrounding quotes."""
    return let(strip(t), lambda x: F.when(F.length(x) > 0, strip(bare(F.split(x, LINE_BREAK, 2)[0]))).otherwise(""))


def decomposition(t: Column) -> Column:
    """``HEAD:`` / ``CLAUSE:`` lines to struct<head, clauses>; the last head counts."""
    def tagged(ls, tag):
        return F.filter(ls, lambda x: F.upper(F.substring(x, 1, len(tag))) == tag)

    def read(ls):
        clauses = F.transform(tagged(ls, "CLAUSE:"), lambda x: F.rtrim(bare(F.substring(x, 8, 1 << 30)), F.lit(".")))
        return F.struct(bare(F.substring(F.try_element_at(tagged(ls, "HEAD:"), F.lit(-1)), 6, 1 << 30)).alias("head"),
                        F.filter(clauses, lambda c: c != "").alias("clauses"))

    return let(F.transform(lines(F.coalesce(t, F.lit(""))), strip), read)


def flip_answer(t: Column) -> Column:
    """First line and the first later ``CHANGED: a -> b`` line to struct<expr, old, new>."""
    def read(s):
        return F.struct(strip(bare(F.coalesce(F.try_element_at(s["ls"], F.lit(1)), F.lit("")))).alias("expr"),
                        bare(F.regexp_extract(s["changed"], CHANGED_LINE, 1)).alias("old"), bare(F.regexp_extract(s["changed"], CHANGED_LINE, 2)).alias("new"))

    def find(ls):
        return F.struct(ls.alias("ls"), F.try_element_at(F.filter(F.slice(ls, 2, 1 << 30), lambda x: x.rlike(CHANGED_LINE)), F.lit(1)).alias("changed"))

    return let(let(F.filter(F.transform(lines(strip(F.coalesce(t, F.lit("")))), strip), lambda x: x != ""), find), read)


def old_new_spans(t: Column) -> Column:
    """``OLD:`` and ``NEW1..3:`` lines to struct<old, news>; the last OLD counts. A text is searched once: a tag ends at
    the first colon of its match, and what follows is its value."""
    def read(found):
        old = F.try_element_at(F.filter(found, lambda m: m["k"] == "OLD"), F.lit(-1))["v"]
        news = F.transform(F.filter(found, lambda m: (m["k"] != "OLD") & (m["v"] != "")), lambda m: m["v"])
        return F.struct(old.alias("old"), news.alias("news"))

    found = F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(OLD_NEW_LINE), F.lit(0)), lambda m: let(F.instr(m, ":"), lambda n: F.struct(
        F.upper(m.substr(F.lit(1), n - 1)).alias("k"), strip(bare(m.substr(n + 1, F.lit(1 << 30)))).alias("v"))))
    return let(found, read)


def describe_answer(t: Column) -> Column:
    """``<description>`` and the numbered ``<details>`` to struct<description, details>."""
    t = F.coalesce(t, F.lit(""))
    body = F.regexp_extract(t, DETAILS_BLOCK, 1)
    details = F.transform(F.regexp_extract_all(body, F.lit(DETAIL_LINE), 2), lambda d: F.regexp_replace(d, r"\.+$", ""))
    return F.struct(F.when(t.rlike(DESCRIPTION_BLOCK), strip(F.regexp_extract(t, DESCRIPTION_BLOCK, 1))).alias("description"), details.alias("details"))


def version_blocks(t: Column) -> Column:
    """``<version kind detail>`` blocks to structs, complete ones only, first per detail."""
    def field(body, key, flags="md"):
        p = rf"(?{flags})^{key}:\s*(.+?)\s*$"
        return F.when(body.rlike(p), strip(F.regexp_extract(body, p, 1)))

    found = F.transform(match_groups(t, VERSION_BLOCK, {"kind": 1, "n": 2, "body": 3}), lambda m: F.struct(
        m["kind"].alias("kind"), (m["n"].cast("int") - 1).alias("idx"), field(m["body"], "old").alias("old"), field(m["body"], "new").alias("new"),
        field(m["body"], "detail").alias("detail"), field(m["body"], "description", "mds").alias("description")))
    full = F.filter(found, lambda v: v["old"].isNotNull() & v["new"].isNotNull() & v["detail"].isNotNull() & v["description"].isNotNull())
    tidy = F.transform(full, lambda v: F.struct(
        v["kind"].alias("kind"), v["idx"].alias("idx"), v["old"].alias("old"), v["new"].alias("new"),
        F.regexp_replace(F.regexp_replace(v["detail"], r"^\s*\d+[.:)]\s*", ""), r"\.+$", "").alias("detail"), v["description"].alias("description")))
    return let(tidy, lambda all_: F.filter(all_, lambda v, i: F.array_position(F.transform(all_, lambda o: o["idx"]), v["idx"]) == i + 1))


def conditions_of(t: Column) -> Column:
    """Numbered condition lines of the ``<conditions>`` block."""
    block = F.regexp_extract(t, CONDITIONS_BLOCK, 1)
    return F.transform(F.filter(lines(block), lambda x: x.rlike(CONDITION_LINE)), lambda x: F.regexp_extract(x, CONDITION_LINE, 2))


def rel_to_px(n: Column, w, h) -> Column:
    return G.box(n[0] * G.num(w) / 1000, n[1] * G.num(h) / 1000, n[2] * G.num(w) / 1000, n[3] * G.num(h) / 1000)


def trace_candidates(t: Column, w, h) -> Column:
    """``<object>`` rows to array<struct<id, box, verdicts map, seen map>>; a malformed box is null."""
    def one(m):
        numbers = F.transform(F.regexp_extract_all(m["nums"], F.lit(NUMBER), 0), lambda x: x.cast("double"))

        def placed(n):
            ok = (F.size(n) == 4) & F.forall(n, lambda v: v.between(0, 1000)) & (F.get(n, F.lit(0)) < F.get(n, F.lit(2))) & (F.get(n, F.lit(1)) < F.get(n, F.lit(3)))
            return F.when(ok, rel_to_px(n, w, h))

        cells = F.transform(match_groups(m["body"], CELL, {"j": 1, "v": 2, "a": 3, "b": 4}), lambda c: F.struct(
            c["j"].cast("int").alias("j"), F.lower(c["v"]).alias("v"), strip(F.when(c["a"] != "", c["a"]).otherwise(c["b"])).alias("why")))
        first = let(cells, lambda cs: let(F.transform(cs, lambda c: c["j"]), lambda js: F.filter(cs, lambda c, i: F.array_position(js, c["j"]) == i + 1)))

        def maps(cs):
            why = F.filter(cs, lambda c: c["why"] != "")
            return F.struct(F.map_from_arrays(F.transform(cs, lambda c: c["j"]), F.transform(cs, lambda c: c["v"])).alias("verdicts"),
                            F.map_from_arrays(F.transform(why, lambda c: c["j"]), F.transform(why, lambda c: c["why"])).alias("seen"))

        return let_all(lambda s: F.struct(m["id"].cast("int").alias("id"), s["box"].alias("box"), s["maps"]["verdicts"].alias("verdicts"), s["maps"]["seen"].alias("seen")),
                       box=let(numbers, placed), maps=let(first, maps))

    return F.transform(match_groups(t, OBJECT_BLOCK, {"id": 1, "nums": 2, "body": 3}), one)


def count_verdict(cand: Column, n: Column, verdict: str) -> Column:
    """How many of the conditions 1..n carry a verdict on a candidate."""
    return F.when(n < 1, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.coalesce(F.element_at(cand["verdicts"], j) == verdict, F.lit(False)))))


def first_best(items: Column, score) -> Column:
    """The element with the highest score; the first one on ties; null for an empty array."""
    scores = F.transform(items, score)
    at = let(scores, lambda s: F.greatest(F.array_position(s, F.array_max(s)), F.lit(1)).cast("int"))
    return F.try_element_at(items, at)


def most_yes(cands: Column, n: Column) -> Column:
    """The candidate with most yes; the first one on ties."""
    return first_best(cands, lambda c: count_verdict(c, n, "yes"))


MAX_CANDIDATES = 6


def trace_table(t: Column, w, h) -> Column:
    """One trace text to struct<conditions, candidates, free_type, free_box, derived_type,
    derived_box, derived_id, format_ok>: the written answer and the one its table implies."""
    t = F.coalesce(t, F.lit(""))
    answer = F.when(t.rlike(ANSWER_BLOCK), F.regexp_extract(t, ANSWER_BLOCK, 1)).otherwise(t)

    def derive(s):
        n = F.size(s["conds"])
        fits = F.filter(s["cands"], lambda c: c["box"].isNotNull() & (count_verdict(c, n, "no") == 0))
        kind = F.when(s["free"]["output_type"] == "box", "box").when(s["free"]["output_type"].isin("none", "refusal"), "null").otherwise("invalid")
        return F.struct(s["conds"].alias("conds"), s["cands"].alias("cands"), s["free"]["box"].alias("free_box"), kind.alias("free_type"), most_yes(fits, n).alias("best"))

    def finish(s):
        n = F.size(s["conds"])
        derived = F.when((F.size(s["cands"]) == 0) | (n == 0), "invalid").when(s["best"].isNull(), "null").otherwise("box")
        complete = F.forall(s["cands"], lambda c: c["box"].isNotNull() & F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.map_contains_key(c["verdicts"], j)))
        ok = (n >= 1) & F.size(s["cands"]).between(1, MAX_CANDIDATES) & complete & (s["free_type"] != "invalid")
        return F.struct(s["conds"].alias("conditions"), s["cands"].alias("candidates"), s["free_type"].alias("free_type"), F.when(s["free_type"] == "box", s["free_box"]).alias("free_box"),
                        derived.alias("derived_type"), F.when(derived == "box", s["best"]["box"]).alias("derived_box"),
                        F.when(derived == "box", s["best"]["id"]).alias("derived_id"), ok.alias("format_ok"))

    return let(let_all(derive, conds=conditions_of(t), cands=trace_candidates(t, w, h), free=parse_box_answer(answer, w, h)), finish)


def tool_boxes(t: Column, w, h, limit: int = MAX_CANDIDATES) -> Column:
    """Valid boxes of the first ``<tool_call>`` in pixels, at most ``limit``."""
    call = F.regexp_extract(F.coalesce(t, F.lit("")), TOOL_BLOCK, 1)
    quads = F.transform(F.regexp_extract_all(call, F.lit(FOUR_IN_BRACKETS), 0),
                        lambda s: F.transform(F.regexp_extract_all(s, F.lit(NUMBER), 0), lambda x: x.cast("double")))
    good = F.filter(quads, lambda b: (b[0] >= 0) & (b[0] < b[2]) & (b[2] <= 1000) & (b[1] >= 0) & (b[1] < b[3]) & (b[3] <= 1000))
    return F.transform(F.slice(good, 1, limit), lambda b: rel_to_px(b, w, h))


def audit_lines(t: Column) -> Column:
    """``n. [type] claim | seen: v | verdict`` lines to struct<lines, verdict, format_ok>."""
    t = F.coalesce(t, F.lit(""))

    def line(m):
        return let(F.lower(m["type"]), lambda kind: F.struct(
            m["n"].cast("int").alias("idx"), F.when(kind.isin(*AUDIT_TYPES), kind).alias("type"),
            strip(m["claimed"]).alias("claimed"), strip(m["seen"]).alias("seen"), F.lower(m["verdict"]).alias("verdict")))

    def read(has):
        body = F.when(has, F.regexp_extract(t, AUDIT_BLOCK, 1)).otherwise(t)
        rows = F.transform(line_groups(body, AUDIT_LINE, {"n": 1, "type": 2, "claimed": 3, "seen": 4, "verdict": 5}), line)
        return let(rows, lambda r: F.struct(r.alias("lines"), F.when(t.rlike(VERDICT_BLOCK), strip(F.regexp_extract(t, VERDICT_BLOCK, 1))).alias("verdict"),
                                            (has & (F.size(r) > 0)).alias("format_ok")))

    return let(t.rlike(AUDIT_BLOCK), read)


def json_phrases(t: Column) -> Column:
    """The JSON object inside a text to struct<head, phrases>; the head is put first when absent."""
    def read(v):
        raw = F.coalesce(F.try_variant_get(v, "$.noun_phrases", "array<string>"), F.array().cast("array<string>"))
        return F.struct(strip(F.lower(F.try_variant_get(v, "$.head_noun", "string"))).alias("head"),
                        F.filter(F.transform(raw, lambda p: strip(F.lower(p))), lambda p: p != "").alias("phrases"))

    def lead(s):
        full = F.when(F.array_contains(s["phrases"], s["head"]), s["phrases"]).otherwise(F.concat(F.array(s["head"]), s["phrases"]))
        return F.when(F.coalesce(s["head"], F.lit("")) != "", F.struct(s["head"].alias("head"), full.alias("phrases")))

    return let(let(F.try_parse_json(F.regexp_extract(F.coalesce(t, F.lit("")), r"(?s)\{.*\}", 0)), read), lead)


def other_phrases(head: Column, phrases: Column) -> Column:
    """Phrases that do not contain the head noun as a word."""
    return F.filter(phrases, lambda p: ~F.array_contains(F.regexp_extract_all(strip(F.lower(p)), F.lit("[a-z]+"), 0), strip(F.lower(head))))


def heuristic_phrase(t: Column) -> Column:
    """Text before the first relational cue, its last word as head: struct<head, phrase>."""
    base = F.regexp_replace(strip(F.lower(t)), r"\.+$", "")
    base = F.regexp_replace(base, "^(?:" + "|".join(ARTICLES) + ")", "")

    def read(phrase):
        head = F.try_element_at(F.regexp_extract_all(phrase, F.lit("[a-z]+"), 0), F.lit(-1))
        return let(head, lambda hd: F.when(hd.isNotNull(), F.struct(hd.alias("head"), F.when(phrase != "", phrase).otherwise(hd).alias("phrase"))))

    return let(strip(F.split(base, "(?U)" + RELATIONAL_CUE, 2)[0]), read)


# ---- rewriting ------------------------------------------------------------------------------


def swap_noun(t: Column, noun: Column, replacement: Column) -> Column:
    """Whole-word, plural-tolerant, case-keeping noun swap: struct<text, hits>."""
    n = strip(noun)
    body = F.concat(quoted(n), F.lit(r"(?:es|s)?\b"))
    hits = F.regexp_count(t, F.concat(F.lit(r"(?iU)\b"), body))
    capital = F.regexp_replace(t, F.concat(F.lit(r"(?U)\b(?=\p{Lu})(?iU:"), body, F.lit(")")), F.lit("\u0001"))
    other = F.regexp_replace(capital, F.concat(F.lit(r"(?iU)\b"), body), F.lit("\u0002"))
    cap = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 30))
    out = F.replace(F.replace(other, F.lit("\u0001"), cap), F.lit("\u0002"), replacement)
    usable = has_text(noun)
    return F.struct(F.when(usable, out).otherwise(t).alias("text"), F.when(usable, hits).otherwise(0).alias("hits"))


def substitute_once(t: Column, old: Column, new: Column) -> Column:
    """``old`` replaced by ``new`` only when it occurs exactly once as a whole word, else null."""
    usable = (old != "") & (new != "") & (F.lower(strip(old)) != F.lower(strip(new)))
    p = whole_word(strip(old))
    return F.when(usable & (F.regexp_count(t, p) == 1), literal_replace(t, p, new))


def align_span(expr: Column, clauses: Column, old: Column, new: Column) -> Column:
    """struct<old, new>: the differing core of two phrases, widened word by word until it
    occurs once in the expression and in exactly one clause; null when that never happens."""
    def split_words(x):
        return F.filter(F.split(F.regexp_replace(strip(x), r"^\.+|\.+$", ""), r"(?U)\s+"), lambda w: w != "")

    def norm_word(w):
        return F.lower(F.regexp_replace(w, r"^[,.;:]+|[,.;:]+$", ""))

    def shared(x, y, limit):
        i = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), lambda k: F.get(x, k - 1) != F.get(y, k - 1)))
        return F.when(limit < 1, 0).otherwise(F.coalesce(i - 1, limit))

    def span(arr, lo, hi):
        return F.when(hi > lo, F.array_join(F.slice(arr, F.greatest(lo, F.lit(0)) + 1, F.greatest(hi - lo, F.lit(0))), " ")).otherwise("")

    def prefix(w):
        return F.struct(w["o"].alias("o"), w["n"].alias("n"), w["a"].alias("a"), w["b"].alias("b"), shared(w["a"], w["b"], F.least(F.size(w["o"]), F.size(w["n"]))).alias("p"))

    def suffix(w):
        s = shared(F.reverse(w["a"]), F.reverse(w["b"]), F.least(F.size(w["o"]), F.size(w["n"])) - w["p"])
        return F.struct(w["o"].alias("o"), w["n"].alias("n"), (w["a"] != w["b"]).alias("differ"), w["p"].alias("p"), s.alias("s"))

    def choose(w):
        no, nn, p, s = F.size(w["o"]), F.size(w["n"]), w["p"], w["s"]
        usable = (no > 0) & (nn > 0) & w["differ"] & (p < no) & (p < nn) & (p + s < no)
        # widening order is part of the result: both sides, then left, then right, one word more each round
        steps = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(p, s)), lambda e: F.array(
            F.struct(e.alias("l"), e.alias("r")), F.struct((e + 1).alias("l"), e.alias("r")), F.struct(e.alias("l"), (e + 1).alias("r")))))
        inside = F.filter(steps, lambda x: (p - x["l"] >= 0) & (no - s + x["r"] <= no))
        spans = F.transform(inside, lambda x: F.struct(
            span(w["o"], p - x["l"], no - s + x["r"]).alias("old"), span(w["n"], p - x["l"], nn - s + x["r"]).alias("new")))
        # spans after the first hit are not looked at
        hit = F.aggregate(spans, F.lit(None).cast("struct<old:string,new:string>"), lambda found, x: F.when(found.isNotNull(), found).when(unique(x), x))
        return F.when(usable, hit)

    def unique(x):
        return (x["old"] != "") & (F.lower(x["old"]) != F.lower(x["new"])) & let(whole_word(x["old"]), lambda w: (
            F.regexp_count(expr, w) == 1) & (F.size(F.filter(clauses, lambda c: F.regexp_count(c, w) > 0)) == 1))

    split = let_all(lambda w: F.struct(w["o"].alias("o"), w["n"].alias("n"), F.transform(w["o"], norm_word).alias("a"), F.transform(w["n"], norm_word).alias("b")),
                    o=split_words(old), n=split_words(new))
    return let(let(let(split, prefix), suffix), choose)


def flip_candidate(expr: Column, clauses: Column, old: Column, new: Column, aligned: Column | None = None) -> Column:
    """One OLD -> NEW value as struct<expr_neg, flipped_idx, clause_neg>: short spans only,
    the head word kept, substituted once in the expression and in one clause; else null.
    ``aligned`` is the ``align_span`` of the same values where it is at hand already."""
    def build(al):
        p = whole_word(al["old"])
        where = F.filter(F.sequence(F.lit(0), F.greatest(F.size(clauses) - 1, F.lit(0))), lambda i: F.regexp_count(F.get(clauses, i), p) > 0)
        short = let_all(lambda w: (F.size(w["o"]) <= 3) & (F.size(w["n"]) <= 3) & (
            (F.size(w["o"]) == F.size(w["n"])) | (F.get(w["o"], F.lit(0)) == F.get(w["n"], F.lit(0))) | (F.element_at(w["o"], -1) == F.element_at(w["n"], -1))),
            o=F.split(F.lower(al["old"]), " "), n=F.split(F.lower(al["new"]), " "))
        return F.struct(al.alias("al"), where.alias("where"), short.alias("short"), substitute_once(expr, al["old"], al["new"]).alias("neg"))

    def check(s):
        i = F.get(s["where"], F.lit(0))
        clause = F.get(clauses, i)
        return let(substitute_once(clause, s["al"]["old"], s["al"]["new"]), lambda cn: F.when(
            s["short"] & s["neg"].isNotNull() & (F.size(s["where"]) == 1) & cn.isNotNull() & (F.lower(strip(cn)) != F.lower(strip(clause))),
            F.struct(s["neg"].alias("expr_neg"), i.alias("flipped_idx"), cn.alias("clause_neg"))))

    return let(align_span(expr, clauses, old, new) if aligned is None else aligned, lambda al: F.when(al.isNotNull(), let(build(al), check)))


def flipped_position(a: Column, b: Column) -> Column:
    """0-based index of the one clause that differs, else null."""
    idx = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))),
                   lambda i: F.lower(strip(F.get(a, i))) != F.lower(strip(F.get(b, i))))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (F.size(idx) == 1), F.get(idx, F.lit(0)))


def join_clauses(head: Column, clauses: Column) -> Column:
    """"the X that a, b, and c"."""
    n = F.size(clauses)
    many = F.concat(F.array_join(F.slice(clauses, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.coalesce(F.try_element_at(clauses, F.lit(-1)), F.lit("")))
    tail = F.when(n == 1, F.get(clauses, F.lit(0))).otherwise(many)
    return F.when(n < 1, F.concat(F.lit("the "), head)).otherwise(F.concat(F.lit("the "), head, F.lit(" that "), tail))


def condition_phrase(name: Column, conds: Column) -> Column:
    """Sentence from conditions; an "is the ..." condition becomes the noun phrase."""
    i = F.array_position(F.transform(conds, lambda c: c.startswith("is the ")), True)
    lead = F.substring(F.get(conds, (i - 1).cast("int")), 4, 1 << 30)
    rest = F.array_join(F.filter(conds, lambda c, k: k != i - 1), " and ")
    with_ordinal = F.concat(F.upper(F.substring(lead, 1, 1)), F.substring(lead, 2, 1 << 30), F.lit(" that "), rest, F.lit("."))
    return F.when(i > 0, with_ordinal).otherwise(F.concat(F.lit("The "), name, F.lit(" that "), F.array_join(conds, " and "), F.lit(".")))


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def clause_category(t: Column) -> Column:
    """Type of a clause by ordered patterns (audit vocabulary)."""
    t = F.lower(t)
    return (F.when(t.rlike(_u(CLAUSE_RELATION)), "relation")
            .when(t.rlike(_u(CLAUSE_TEXT)) & ~t.rlike(_u(CLAUSE_TEXT_NOT)), "text")
            .when(t.rlike(_u(CLAUSE_COLOR)), "color").when(t.rlike(_u(CLAUSE_COUNT)), "count")
            .when(t.rlike(_u(CLAUSE_MATERIAL)), "material").when(t.rlike(_u(CLAUSE_STATE)), "state")
            .when(t.rlike(_u(CLAUSE_SHAPE)), "shape").otherwise("part"))


def line_category(t: Column) -> Column:
    """Type of a clause by ordered patterns (report vocabulary)."""
    t = F.lower(t)
    expr = None
    for name, pattern in LINE_CATEGORIES:
        expr = F.when(t.rlike(_u(pattern)), name) if expr is None else expr.when(t.rlike(_u(pattern)), name)
    return expr.otherwise("other")


def norm(t: Column) -> Column:
    """Lower-case content words joined by one blank."""
    s = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, NORM_DROP, " "), r"\s+", " "))


def norm_words(t: Column) -> Column:
    """The distinct words of ``norm(t)``, found by one search."""
    return words(t, NORM_DROP[3:-3].split("|"))


def content_words(t: Column) -> Column:
    return words(t, (*NORM_DROP[3:-3].split("|"), *NEGATIONS))


def named_value(seen: Column, claimed: Column) -> Column:
    """The seen value names something beyond the claim."""
    return let(content_words(seen), lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, norm_words(claimed))) > 0))


def named_mismatches(audit_rows: Column) -> Column:
    """Lines that reject a candidate: mismatches whose seen value is named."""
    return F.filter(audit_rows, lambda r: (r["verdict"] == "mismatch") & named_value(r["seen"], r["claimed"]))


def paraphrase(a: Column, b: Column) -> Column:
    """Content-word Jaccard of at least one half."""
    return let_all(lambda s: (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0) & (jaccard(s["a"], s["b"]) >= 0.5),
                   a=words(a, PARAPHRASE_STOP), b=words(b, PARAPHRASE_STOP))


def align_clause(conds: Column, clause: Column) -> Column:
    """1-based index of the condition closest to a clause (Jaccard >= 0.3, first on ties)."""
    scores = let(words(clause, ALIGN_STOP), lambda w: F.transform(conds, lambda c: jaccard(w, words(c, ALIGN_STOP))))
    at = let(scores, lambda s: F.when(F.array_max(s) >= 0.3, F.array_position(s, F.array_max(s)).cast("int")))
    return F.when(F.coalesce(clause, F.lit("")) != "", at)


def word_flip(t: Column, captions: Column, seed, key: Column) -> Column:
    """One colour / side / ordinal word turned into its opposite: struct<text, from, to, kind>.

    The word must be unique in the text, a colour never becomes a colour another caption of
    the object uses, and texts on the skip list give null. The word is picked by hash."""
    def literal_map(d):
        return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])

    colour, other = literal_map(COLOUR_SWAP), literal_map(WORD_SWAP)
    def to(w):
        return F.coalesce(F.element_at(colour, F.lower(w)), F.element_at(other, F.lower(w)))

    def edge(w):
        return F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b"))

    used = F.flatten(F.transform(captions, lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)))
    ws = F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), 0), lambda w: F.struct(w.alias("w"), to(w).alias("to")))
    options = let(used, lambda u: F.filter(ws, lambda o: o["to"].isNotNull()
                                           & ~(F.map_contains_key(colour, F.lower(o["w"])) & F.array_contains(u, o["to"]))
                                           & (F.regexp_count(t, edge(o["w"])) == 1)))
    choice = let(options, lambda os: F.when(F.size(os) > 0, F.get(os, (seeded_int(seed, key) % F.greatest(F.size(os), F.lit(1))).cast("int"))))

    def apply(o):
        w, new = o["w"], o["to"]
        cased = (F.when((w == F.upper(w)) & w.rlike("[A-Z]"), F.upper(new))
                 .when(w.rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 30))).otherwise(new))
        kind = F.when(F.map_contains_key(colour, F.lower(w)), "colour").otherwise(F.element_at(literal_map(EDIT_KIND), F.lower(w)))
        return F.when(o.isNotNull(), F.struct(literal_replace(t, edge(w), cased).alias("text"), F.lower(w).alias("from"), new.alias("to"), kind.alias("kind")))

    return F.when(~t.rlike(FLIP_SKIP), let(choice, apply))


def ordinal_wording(t: Column) -> Column:
    return F.lower(t).rlike("|".join(re.escape(w) for w in ORDINAL_WORDS))


def head_noun(label: Column) -> Column:
    """Label to display noun: a small literal map, else lower case."""
    m = F.create_map(*[F.lit(x) for kv in HEAD_NOUNS.items() for x in kv])
    return F.coalesce(F.element_at(m, label), F.lower(label))


# ---- rendering ------------------------------------------------------------------------------


def prompt_parts(t: Column) -> Column:
    """A prompt file to struct<body, meta map, version>: ``# key: value`` header lines (with
    continuations) before the first body line; the version hashes the whole text."""
    empty = F.array().cast("array<struct<k:string,v:string>>")

    def fold(acc, x):
        is_key = x.rlike(PROMPT_HEADER)
        entry = F.struct(F.regexp_extract(x, PROMPT_HEADER, 1).alias("k"), strip(F.regexp_extract(x, PROMPT_HEADER, 2)).alias("v"))
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["k"].alias("k"), strip(F.concat(last["v"], F.lit(" "), F.regexp_replace(F.regexp_replace(x, "^[# ]+", ""), r"\s+$", ""))).alias("v"))
        return (F.when(is_key, F.concat(F.filter(acc, lambda e: e["k"] != entry["k"]), F.array(entry)))
                .when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(acc))

    def is_body(x):
        return has_text(x) & ~F.ltrim(x).startswith("#")

    def parts(s):
        head = F.filter(F.slice(s["ls"], 1, s["start"] - 1), has_text)
        body = strip(F.array_join(F.slice(s["ls"], s["start"], F.greatest(F.size(s["ls"]) - s["start"] + 1, F.lit(0))), "\n"))
        return F.struct(body.alias("body"), F.map_from_entries(F.aggregate(head, empty, fold)).alias("meta"), F.sha2(t, 256).alias("version"))

    def locate(ls):
        flags = F.transform(ls, is_body)
        return F.struct(ls.alias("ls"), let(F.array_position(flags, True), lambda p: F.when(p > 0, p).otherwise(F.size(ls) + 1).cast("int")).alias("start"))

    return let(let(lines(t), locate), parts)


def render_prompt(body: Column, fields: dict[str, Column]) -> Column:
    """``{name}`` fields filled in; an unknown field is an error; doubled braces are literal."""
    out = F.replace(F.replace(body, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    for i, name in enumerate(fields):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"\u0003{i}\u0004"))
    missing = F.regexp_extract(out, r"\{([a-z_]+)\}", 1)
    out = F.when(missing != "", F.raise_error(F.concat(F.lit("prompt needs field "), missing)).cast("string")).otherwise(out)
    for i, value in enumerate(fields.values()):
        out = F.replace(out, F.lit(f"\u0003{i}\u0004"), value)
    return F.replace(F.replace(out, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))


def int_list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda v: v.cast("string")), ", "), F.lit("]"))


def answer_json(rel: Column) -> Column:
    """``{"bbox_2d": [..]}`` or null."""
    return F.concat(F.lit('{"bbox_2d": '), F.coalesce(int_list(rel), F.lit("null")), F.lit("}"))


def target_text(rel: Column) -> Column:
    return F.concat(F.lit("```json\n"), answer_json(rel), F.lit("\n```"))


def render_conditions(conds: Column) -> Column:
    body = F.transform(conds, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    return F.concat(F.lit("<conditions>\n"), F.array_join(body, "\n"), F.lit("\n</conditions>"))


def render_cell(j: Column, verdict: Column, reason: Column, style: str) -> Column:
    """One cell; ``yn`` verdict only, ``obs`` with the seen value, ``rat`` with a reason."""
    base = F.concat(j.cast("string"), F.lit(": "), verdict)
    if style == "obs":
        return F.when((verdict == "no") & (F.coalesce(reason, F.lit("")) != ""), F.concat(base, F.lit(" (seen: "), reason, F.lit(")"))).otherwise(base)
    if style == "rat":
        clean = clean_reason(reason)
        return F.when(clean.isNotNull(), F.concat(base, F.lit(" — "), clean)).otherwise(base)
    return base


def render_candidates(rows: Column, style: str = "yn") -> Column:
    """array<struct<rel, cells: array<struct<verdict, reason>>>> in order -> ``<candidates>``."""
    def one(r, k):
        cells = F.transform(r["cells"], lambda c, j: render_cell(j + 1, c["verdict"], c["reason"], style))
        fits = ~F.exists(r["cells"], lambda c: c["verdict"] == "no")
        return F.concat(F.lit('<object id="'), (k + 1).cast("string"), F.lit('" bbox="'), int_list(r["rel"]), F.lit('">'), F.array_join(cells, "; "),
                        F.when(fits, " -> fits").otherwise(" -> excluded"), F.lit("</object>"))

    return F.concat(F.lit("<candidates>\n"), F.array_join(F.transform(rows, one), "\n"), F.lit("\n</candidates>"))


def render_trace(conds: Column, rows: Column, answer_rel: Column, style: str = "yn") -> Column:
    return F.concat(render_conditions(conds), F.lit("\n"), render_candidates(rows, style), F.lit("\n<answer>"), answer_json(answer_rel), F.lit("</answer>"))


def render_audit(conds: Column, verdicts: Column, seen: Column) -> Column:
    """Label audit block: a "no" without a named counter-value is taught as unsure."""
    rows = F.transform(F.arrays_zip(conds.alias("c"), verdicts.alias("v"), seen.alias("s")), lambda r, j: F.struct(
        (j + 1).alias("n"), r["c"].alias("c"), F.coalesce(r["s"], r["c"]).alias("s"),
        F.when(r["v"] == "yes", "match").when((r["v"] == "no") & named_value(F.coalesce(r["s"], r["c"]), r["c"]), "mismatch").otherwise("unsure").alias("v")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(r["n"].cast("string"), F.lit(". "), r["c"], F.lit(" | seen: "), r["s"], F.lit(" | "), r["v"])), "\n")
    bad = F.try_element_at(F.filter(rows, lambda r: r["v"] == "mismatch"), F.lit(1))
    verdict = F.when(bad.isNull(), "fits").otherwise(F.concat(F.lit("mismatch on "), bad["n"].cast("string"), F.lit(": "), bad["s"], F.lit(", not "), bad["c"]))
    return F.concat(F.lit("<audit>\n"), body, F.lit("\n</audit>\n<verdict>"), verdict, F.lit("</verdict>"))


def clean_reason(t: Column) -> Column:
    """Separators removed, first twelve words; null when nothing is left."""
    s = F.replace(F.regexp_replace(t, r"[;\n<>]", ","), F.lit("->"), F.lit("to"))
    s = F.regexp_replace(s, r"^[ .,]+|[ .,]+$", "")
    ws = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(ws) > 0, F.array_join(F.slice(ws, 1, REASON_WORDS), " "))


def replace_tool_call(t: Column, boxes_json: Column) -> Column:
    """The first tool call replaced by a new one; appended when there is none."""
    call = F.concat(F.lit('<tool_call>{"name": "image_zoom_in", "arguments": {"boxes": '), boxes_json, F.lit("}}</tool_call>"))
    a, z = F.locate("<tool_call>", t), F.locate("</tool_call>", t)
    swapped = F.concat(F.substring(t, F.lit(1), a - 1), call, F.substring(t, z + len("</tool_call>"), F.lit(1 << 30)))
    return F.when((a > 0) & (a < z), swapped).otherwise(F.concat(t, F.lit("\n"), call))
