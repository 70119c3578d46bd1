"""Text functions: quoting, trigrams, phonetics, patterns, search vectors, paths of labels, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what replaces them.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŠšŽž"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyySsZz"
# English words without content, for search vectors.
STOP = "a about after all also an and any are as at be because been but by can did do does for from had has have he her his how i if in into is it its just me more my no not now of on only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()


def concat_skip_null(*parts: Column) -> Column:
    """concat that treats null as empty."""
    return F.concat_ws("", *parts)


def quote_literal(s: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(s, "'", "''"), r"\\", r"\\\\\\\\")
    return F.when(s.contains("\\"), F.concat(F.lit("E'"), body, F.lit("'"))).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    return F.when(s.rlike("^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"')))


def unaccent(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, ACCENTED, PLAIN), "ß", "ss")


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of trigrams."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def word_similarity(a: Column, b: Column) -> Column:
    """Share of a's trigrams that b has."""
    x = trigrams(a)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, trigrams(b))) / F.size(x))


def difference(a: Column, b: Column) -> Column:
    """How many of the four soundex places agree."""
    x, y = F.soundex(a), F.soundex(b)
    return sum((F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 1).otherwise(0) for i in range(1, 5)), F.lit(0))


def metaphone(s: Column, length: int = 8) -> Column:
    """A consonant code: rules of English spelling applied in order to the upper-case letters."""
    t = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    for pattern, code in (
        ("^(?:A(?=E)|[GKP](?=N)|W(?=R))", ""), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), (r"([^C])\1+", "$1"), ("SCH", "SK"), ("C(?=IA)", "X"), ("CH", "X"), ("S?C(?=[EIY])", "S"), ("CK|C|Q", "K"),
        ("DG(?=[EIY])", "J"), ("D", "T"), ("GH(?=[^AEIOU]|$)", ""), ("GN(?=$|ED$)", "N"), ("G(?=[EIY])", "J"), ("G", "K"), ("PH", "F"), ("SH|S(?=I[OA])", "X"), ("T(?=I[OA])", "X"), ("TH", "0"), ("TCH", "X"), ("V", "F"),
        ("Z", "S"), ("(?<=[AEIOU])H(?![AEIOU])", ""), ("[WY](?![AEIOU])", ""), ("(?<=.)[AEIOU]", ""),
    ):
        t = F.regexp_replace(t, pattern, code)
    return F.substring(t, 1, length)


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """SIMILAR TO as a regular expression: % any run, _ any character, the rest as there, anchored at both ends."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "|*+?{}()":
            out.append(c)
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    return s.rlike("(?s)" + similar_pattern(pattern, escape))


def regexp_first(s: Column, pattern: str, replacement: str) -> Column:
    """regexp_replace without the global flag: the first match only."""
    return F.regexp_replace(s, "(?s)^(.*?)(?:" + pattern + ")", "$1" + replacement.replace("$", r"\$"))


def to_tsvector(s: Column) -> Column:
    """Lexemes with their positions: lower-case words without stop words, light plural stemming."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(F.regexp_replace(w, "(?<=[a-z]{3})(?:es|s)$", "").alias("lexeme"), (i + 1).alias("pos"), w.alias("word")))
    kept = F.filter(placed, lambda p: ~p["word"].isin(STOP))
    return F.transform(kept, lambda p: F.struct(p["lexeme"].alias("lexeme"), p["pos"].alias("pos")))


def ts_match(vector: Column, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> Column:  # type: ignore[assignment]
    """All of `every`, one of `some` if there are any, none of `none`."""
    lexemes = F.transform(vector, lambda p: p["lexeme"])
    out = F.lit(True)
    for w in every:
        out = out & F.array_contains(lexemes, w)
    if some:
        out = out & F.arrays_overlap(lexemes, F.array(*map(F.lit, some)))
    for w in none:
        out = out & ~F.array_contains(lexemes, w)
    return out


def ts_phrase(vector: Column, first: str, second: str, distance: int = 1) -> Column:
    """Two lexemes at a distance."""
    return F.exists(vector, lambda p: (p["lexeme"] == first) & F.exists(vector, lambda q: (q["lexeme"] == second) & (q["pos"] == p["pos"] + distance)))


def ts_rank(vector: Column, words: list[str]) -> Column:
    """Share of places that hold one of the words."""
    hits = F.size(F.filter(vector, lambda p: p["lexeme"].isin(words)))
    return F.when(F.size(vector) == 0, 0.0).otherwise(hits / F.size(vector))


# Paths of labels: 'a.b.c'


def nlevel(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, r"\.")))


def subpath(path: Column, offset: int, length: int | None = None) -> Column:
    labels = F.split(path, r"\.")
    start = F.lit(offset + 1) if offset >= 0 else F.size(labels) + offset + 1
    return F.array_join(F.slice(labels, start, F.lit(length) if length is not None else F.size(labels)), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a is b or stands above it."""
    return (a == "") | (a == b) | b.startswith(F.concat(a, F.lit(".")))


# IPv4 addresses with an optional /length


def inet_number(a: Column) -> Column:
    parts = F.split(F.split_part(a, F.lit("/"), F.lit(1)), r"\.")
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))


def inet_text(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)])


def masklen(a: Column) -> Column:
    return F.when(a.contains("/"), F.split_part(a, F.lit("/"), F.lit(2)).cast("int")).otherwise(32)


def host(a: Column) -> Column:
    return F.split_part(a, F.lit("/"), F.lit(1))


def network(a: Column) -> Column:
    size = F.pow(F.lit(2.0), F.lit(32) - masklen(a)).cast("long")
    return F.concat(inet_text(inet_number(a) - F.pmod(inet_number(a), size)), F.lit("/"), masklen(a).cast("string"))


def broadcast(a: Column) -> Column:
    size = F.pow(F.lit(2.0), F.lit(32) - masklen(a)).cast("long")
    return F.concat(inet_text(inet_number(a) - F.pmod(inet_number(a), size) + size - 1), F.lit("/"), masklen(a).cast("string"))


def inet_contains(net: Column, a: Column) -> Column:
    """a lies in net, or is net."""
    size = F.pow(F.lit(2.0), F.lit(32) - masklen(net)).cast("long")
    return (masklen(net) <= masklen(a)) & (inet_number(net) - F.pmod(inet_number(net), size) == inet_number(a) - F.pmod(inet_number(a), size))


def isbn13_valid(s: Column) -> Column:
    """Thirteen digits whose weighted sum is a multiple of ten."""
    digits = F.split(F.regexp_replace(s, "[^0-9]", ""), "")
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return (F.length(F.regexp_replace(s, "[^0-9]", "")) == 13) & (total % 10 == 0)


# Keyed digests and text-search queries


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The keyed digest of a message (binary or text) in hex, by the definition of HMAC over SHA-256 with blocks of 64 bytes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


QUERY_TOKEN = re.compile(r"\s*(<(?:-|\d+)>|[&|!()]|[^\s&|!()<>]+)")


def ts_query(vector: Column, query: str) -> Column:
    """Whether a vector matches a query text: words with & (and), | (or), ! (not), <-> or <n> (at that distance) and
    parentheses; `word:*` is a prefix. Distances bind words and distances of words, as in a phrase."""
    tokens, at = QUERY_TOKEN.findall(query), 0
    if "".join(tokens) != "".join(query.split()):
        raise ValueError(f"not a text-search query: {query!r}")

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if peek() is None:
            raise ValueError(f"the query ends too early: {query!r}")
        at += 1
        return tokens[at - 1]

    def word(w: str) -> Column:
        """Positions of a word."""
        hit = (lambda p: p["lexeme"].startswith(w[:-2].lower())) if w.endswith(":*") else (lambda p: p["lexeme"] == w.lower())
        return F.transform(F.filter(vector, hit), lambda p: p["pos"])

    def near(before: Column, after: Column, distance: int) -> Column:
        return F.filter(after, lambda p: F.array_contains(before, p - distance))

    def factor() -> tuple[Column | None, Column]:
        t = take()
        if t == "!":
            return None, ~factor()[1]
        if t == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"a parenthesis is not closed: {query!r}")
            return None, out
        if t in "&|)" or t[0] == "<":
            raise ValueError(f"a word is missing before {t!r}")
        places = word(t)
        return places, F.size(places) > 0

    def phrase() -> Column:
        places, out = factor()
        while (t := peek()) and t[0] == "<":
            distance = 1 if take() == "<->" else int(t[1:-1])
            after, _ = factor()
            if places is None or after is None:
                raise ValueError("distances are between words")
            places = near(places, after, distance)
            out = F.size(places) > 0
        return out

    def both() -> Column:
        out = phrase()
        while peek() == "&":
            take()
            out = out & phrase()
        return out

    def either() -> Column:
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    if not tokens:
        return F.lit(False)
    out = either()
    if peek() is not None:
        raise ValueError(f"not understood from {peek()!r} on: {query!r}")
    return out
