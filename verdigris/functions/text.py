"""Scalar text functions: each takes and gives columns, in built-in expressions only.

Patterns avoid look-around and back-references where an oracle in RE2 must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris import vocab

TOKEN = r"[\p{L}\p{N}_]+"


def fixed_chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of (start, chunk) with stride size - overlap; the last may be pure overlap."""
    if size <= overlap:
        raise ValueError("chunk size must exceed the overlap")
    stride = size - overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("chunk")))


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def section_chunks(text: Column, size: int = 2048, overlap: int = 256, least: int = 80) -> Column:
    """Array of (start, chunk): markdown sections, squeezed, cut; short ones are dropped.

    The offset of a section advances by its raw length, so starts are approximate.
    """
    sections = F.split(text, r"(?m)(?=^#{1,6} )|^-{3,}\s*$")

    def cut(s: Column) -> Column:
        flat = s["flat"]
        starts = F.when(F.length(flat) >= least, F.sequence(F.lit(0), F.length(flat) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        made = F.transform(starts, lambda k: F.struct((s["offset"] + k).alias("start"), F.trim(F.substring(flat, k + 1, F.lit(size))).alias("chunk")))
        return F.filter(made, lambda c: F.length(c["chunk"]) >= least)

    empty = F.array().cast("array<struct<offset:int,flat:string>>")
    placed = F.aggregate(sections, F.struct(F.lit(0).alias("at"), empty.alias("all")), lambda a, s: F.struct((a["at"] + F.length(s)).alias("at"), F.array_append(a["all"], F.struct(a["at"].alias("offset"), squeezed(s).alias("flat"))).alias("all")), lambda a: a["all"])
    return F.flatten(F.transform(placed, cut))


def article_chunks(text: Column, size: int = 1536, overlap: int = 256, least: int = 80) -> Column:
    """Array of chunks: none below ``least`` characters, one up to ``size``, else cut and trimmed."""
    many = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap)), lambda s: F.trim(F.substring(text, s + 1, F.lit(size)))), lambda c: c != "")
    return F.when(F.length(text) < least, F.array().cast("array<string>")).when(F.length(text) <= size, F.array(text)).otherwise(many)


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")


def stripped(html: Column) -> Column:
    """Tags to spaces, white space squeezed."""
    return squeezed(F.regexp_replace(html, r"<[^>]+>", " "))


def unescaped(html: Column) -> Column:
    """Tags removed, then five entities decoded in order, the ampersand first."""
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def snippet(text: Column, most: int = 400) -> Column:
    """Cut at the last space within ``most`` characters and mark the cut."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(F.locate(" ", head) > 1, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, no slash at the path's end, no fragment; the query stays."""
    p = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    whole = F.concat(F.lower(F.regexp_extract(url, p, 1)), F.lit("://"), F.lower(F.regexp_extract(url, p, 2)), F.regexp_replace(F.regexp_extract(url, p, 3), "/+$", ""), F.coalesce(F.regexp_extract(url, p, 4), F.lit("")))
    return F.when(url.rlike(p), whole).otherwise(url)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def source_name(url: Column) -> Column:
    """The host less any leading run of the characters w and dot."""
    return F.regexp_replace(host(url), r"^[w.]+", "")


def first_sentence(text: Column) -> Column:
    """Up to and with the first full stop, exclamation or question mark before white space."""
    found = F.regexp_extract(F.trim(text), r"^(.*?[.!?])\s", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def script_language(text: Column, previous: Column | None = None) -> Column:
    """Language by script; Latin text by the most frequent function words, else the previous, else en."""
    latin = F.regexp_count(text, F.lit("[A-Za-z]")) >= 6
    vote = voted_language(text)
    return (
        F.when(text.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").when(text.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(text.rlike(r"[\x{0600}-\x{06FF}]"), "ar").when(text.rlike(r"[\x{0400}-\x{04FF}]"), "ru")
        .when(latin & vote.isNotNull(), vote).otherwise(F.coalesce(previous if previous is not None else F.lit(None), F.lit("en")))
    )


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times."""
    return F.transform(F.array(value), body)[0]


def voted_language(text: Column, languages: dict[str, tuple[str, ...]] = vocab.PROBE_LANGUAGES) -> Column:
    """The language with most function words; ties go to the first listed, none gives null."""
    every = F.array(*(F.lit(w) for words in languages.values() for w in words))
    known = F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda t: F.array_contains(every, t))
    count = lambda t, words: F.size(F.filter(t, lambda x: x.isin(*words)))
    counts = let(known, lambda t: F.array(*(count(t, words) for words in languages.values())))
    names = F.array(*(F.lit(k) for k in languages))
    return let(counts, lambda c: F.when(F.array_max(c) > 0, F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))))


def word_or_cjk_count(text: Column) -> Column:
    """Latin words plus CJK characters."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+")) + F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"))


def cjk_majority(text: Column) -> Column:
    """ja if CJK characters outnumber Latin letters, else en."""
    return F.when(F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")) > F.regexp_count(text, F.lit("[A-Za-z]")), "ja").otherwise("en")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")


def canonical_terms(text: Column, terms: dict[str, str]) -> Column:
    """(text, hits): terms replaced, the longest first."""
    order = sorted(terms, key=lambda t: (-len(t), t))
    table = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(terms[t]).alias("to")) for t in order))
    none = F.array().cast("array<string>")
    return F.aggregate(table, F.struct(text.alias("text"), none.alias("hits")), lambda a, t: F.when(F.contains(a["text"], t["term"]), F.struct(F.replace(a["text"], t["term"], t["to"]).alias("text"), F.array_append(a["hits"], t["term"]).alias("hits"))).otherwise(a))


def glossary(pairs: Column) -> Column:
    """`a = b; c = d` from an array of (term, to)."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["term"], F.lit(" = "), p["to"])), "; ")


def core_proposition(text: Column, number_words=vocab.NUMBER_WORDS, places: tuple[str, ...] = ("paris", "euro", "dollar")) -> Column:
    """The first of: digit number, number word, place or currency, proper noun, title-case word, first characters."""
    t = F.trim(text)
    one = lambda p, g=1, of=t: F.nullif(F.regexp_extract(of, p, g), F.lit(""))
    number = F.lower(F.replace(one(r"(^|[^A-Za-z0-9])([0-9][0-9,]*(\.[0-9]+)?)", 2), F.lit(",")))
    word = one(vocab.pattern(number_words), 2, F.lower(t))
    value = F.lit(None).cast("string")
    for k, w in enumerate(number_words, 1):
        value = F.when(word == w, str(k)).otherwise(value)
    proper = F.lower(one(r"(^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)", 2))
    title = F.lower(one(r"(^|\s)([A-Z][a-z]{3,})(\s|$|[.,])", 2))
    found = F.coalesce(number, value, one(vocab.pattern(places), 2, F.lower(t)), proper, title, F.trim(F.lower(F.substring(t, 1, 20))))
    return F.when((t == "") | t.isNull() | t.startswith("[ERROR]"), "__error__").otherwise(found)


def key_tokens(text: Column, stop=vocab.STOP_WORDS) -> Column:
    """Distinct lower-cased tokens of two characters or more that are no stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9-]*"), 0)
    return F.array_except(F.filter(F.array_distinct(tokens), lambda t: F.length(t) >= 2), vocab.array(stop))


def numbers_as_digits(text: Column, words=vocab.NUMBER_WORDS) -> Column:
    out = F.lower(text)
    for k, w in enumerate(words, 1):
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])", str(k))
    return out


def supported(answer: Column, rationale: Column) -> Column:
    """Whether the rationale shares a word with the answer; a bare number needs itself and two other words."""
    a, r = numbers_as_digits(answer), numbers_as_digits(rationale)
    at, rt = key_tokens(a), key_tokens(r)
    digit, word = (lambda x: F.filter(x, lambda t: t.rlike("^[0-9]+$"))), (lambda x: F.filter(x, lambda t: ~t.rlike("^[0-9]+$")))
    shared = F.arrays_overlap(F.regexp_extract_all(a, F.lit(r"\b\d+\b"), 0), F.regexp_extract_all(r, F.lit(r"\b\d+\b"), 0))
    return (
        F.when(rationale.isNull() | (rationale == "") | rationale.startswith("[ERROR]"), False).when(F.size(at) == 0, True)
        .when(F.size(word(at)) > 0, F.size(F.array_intersect(word(at), rt)) > 0).otherwise(shared & (F.size(word(rt)) >= 2) & (F.size(digit(at)) >= 0))
    )


def core_answer(answer: Column, markers: tuple[str, ...] = ("Reflective Note:", "User:", "Note:", "Important:")) -> Column:
    """The first paragraph, cut at a marker, of 80 characters at most."""
    core = F.trim(F.substring_index(answer, "\n\n", 1))
    for m in markers:
        core = F.trim(F.substring_index(core, m, 1))
    return F.when(core != "", F.substring(core, 1, 80)).otherwise(F.substring(answer, 1, 80))


def noise_turn(text: Column, words: tuple[str, ...] = ("hi", "hello", "ok", "okay", "thanks", "error")) -> Column:
    return F.lower(F.trim(text)).rlike("^(" + "|".join(words) + ")[.!?]*$")


def casual_greeting(text: Column, words: tuple[str, ...] = ("hi", "hello", "hey", "good morning", "hallo", "salut", "hola")) -> Column:
    """Short, no question mark, and begins with a greeting."""
    return (F.length(F.trim(text)) <= 20) & ~F.contains(text, F.lit("?")) & F.lower(F.trim(text)).rlike("^(" + "|".join(words) + r")([^a-z]|$)")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def long_tokens(text: Column, least: int) -> Column:
    """Distinct tokens of at least so many characters."""
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= least))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens of three characters or more over the smaller set; 0 if one is empty."""
    x, y = (F.array_distinct(F.filter(tokens(t), lambda w: F.length(w) >= 3)) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y))), F.lit(0.0))


def all_grams(text: Column, n: int) -> Column:
    """Every character n-gram of the whole text, in order and with repeats; a shorter text has none.

    Each match takes one code point and looks ahead, so the time is in proportion to the length.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), 1)


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only one."""
    return F.when(F.length(text) >= n, F.array_distinct(all_grams(text, n))).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    x, y = grams(a, n), grams(b, n)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def tier(text: Column, high: tuple[str, ...], middle: tuple[str, ...]) -> Column:
    """2, 1 or 0 by which list a word is on."""
    return F.when(vocab.has(text, high), 2).when(vocab.has(text, middle), 1).otherwise(0)


def cues(text: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """Names of the lists with a word in the text, in the lists' order."""
    return F.array_compact(F.array(*(F.when(vocab.has(text, words), F.lit(name)) for name, words in lists.items())))


def entity_mentions(text: Column) -> Column:
    """Katakana runs and capitalised words of three letters or more."""
    return F.regexp_extract_all(text, F.lit(r"[\x{30A0}-\x{30FF}]{2,}|[A-Z][a-z]{2,}"), 0)


def recent_entities(found: Column, depth: int = 5) -> Column:
    """The latest distinct entities first."""
    return F.slice(F.array_distinct(F.reverse(found)), 1, depth)


def replaced_in_order(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_question(sentence: Column, starts: tuple[str, ...] = ("what", "who", "when", "where", "why", "how")) -> Column:
    """11 to 199 characters that end in a question mark or begin with a question word."""
    s = F.trim(sentence)
    return F.length(s).between(11, 199) & (s.endswith("?") | F.lower(s).rlike("^(" + "|".join(starts) + ")[^a-z]"))


def short_answer(text: Column) -> Column:
    """Lower-cased, leading articles dropped one each, punctuation but the hyphen to spaces, squeezed."""
    out = F.trim(F.lower(text))
    for a in ("the ", "a ", "an "):
        out = F.regexp_replace(out, "^" + a, "")
    return squeezed(F.regexp_replace(out, r"[!-,./:-@\[-`{-~]", " "))


def negated_before(text: Column, at: Column, words: tuple[str, ...] = ("not ", "isn't", "never ", "incorrect"), window: int = 30) -> Column:
    """Whether a negation stands in the characters before a place (from 0)."""
    start = F.greatest(at - window, F.lit(0))
    before = F.lower(F.substring(text, start + 1, at - start))
    return F.coalesce(before.rlike("|".join(words)), F.lit(False))


def parsed_letter(response: Column, letters: str = "ABCDEFGHIJ") -> tuple[Column, Column]:
    """(letter, layer) of a multiple-choice answer by the first of six layers that finds one."""
    raw, one = F.trim(response), f"[{letters}]"
    bare = F.trim(F.regexp_replace(raw, r"[.)]+$", ""))
    first = lambda p, g=1: F.nullif(F.regexp_extract(raw, p, g), F.lit(""))
    tagged = [rf"(?i)\banswer(\s+is)?\s*[:-]?\s*\(?({one})\)?\b", rf"(?i)\b(i\s+choose|i\s+pick|i\s+select|i\s+go\s+with)\s+\(?({one})\)?\b", rf"(?i)\b(option|choice)\s+\(?({one})\)?\b"]
    head = F.substring(raw, 1, 300)
    last = F.regexp_extract(head, rf"(?s)^(.*)(?<![A-Za-z])({one})(?![A-Za-z])", 2)
    at = F.length(F.regexp_extract(head, rf"(?s)^(.*)(?<![A-Za-z])({one})(?![A-Za-z])", 1))
    layers = (
        ("exact", F.when(bare.rlike(f"^{one}$"), bare)), ("bold", first(rf"\*\*\s*({one})\s*\*\*")), ("tagged", F.upper(F.coalesce(*(first(p, 2) for p in tagged)))),
        ("terminal", first(rf"\(({one})\)\s*\.?\s*$")), ("boxed", first(r"\\boxed\{\s*(" + one + r")\s*\}")), ("last", F.when((last != "") & ~negated_before(head, at), last)),
    )
    value, layer = F.coalesce(*(v for _, v in layers)), F.lit("none")
    for name, v in reversed(layers):
        layer = F.when(v.isNotNull(), name).otherwise(layer)
    return value, layer


def parsed_number(response: Column, most: Column | int) -> tuple[Column, Column]:
    """(number, layer) within 1..most by the first of four layers that finds one."""
    raw, most = F.trim(response), most if isinstance(most, Column) else F.lit(most)
    good = lambda x: F.when(x.rlike("^[1-9][0-9]{0,3}$") & (x.try_cast("int") <= most), x)
    tagged = [(r"(?i)\banswer(\s+is)?\s*[:-]?\s*(\d+)\b", 2), (r"(?i)\b(option|choice)\s+(\d+)\b", 2), (r"(?i)\b(i\s+choose|i\s+pick|i\s+select)\s+(\d+)\b", 2)]
    scan = F.get(F.filter(F.regexp_extract_all(F.substring(raw, 1, 200), F.lit(r"\d+"), 0), lambda x: good(x).isNotNull()), 0)
    layers = (("exact", good(F.trim(F.regexp_replace(raw, r"[.)]+$", "")))), ("bold", good(F.regexp_extract(raw, r"\*\*\s*(\d+)\s*\*\*", 1))), ("tagged", F.coalesce(*(good(F.regexp_extract(raw, p, g)) for p, g in tagged))), ("first", scan))
    value, layer = F.coalesce(*(v for _, v in layers)), F.lit("none")
    for name, v in reversed(layers):
        layer = F.when(v.isNotNull(), name).otherwise(layer)
    return value, layer


def routing_override(decision: Column) -> Column:
    """A set decision other than answer goes before any parsing."""
    return decision.isNotNull() & (decision != "answer")


def score_answers(replies: DataFrame, abstain: tuple[str, ...] = ("i don't know", "cannot determine", "unable to")) -> DataFrame:
    """Add (verdict, layer) to (response, gold, decision): the first layer that decides.

    The normalised answers are columns of their own, which keeps the generated code small.
    """
    plain = replies.withColumns({"__r": short_answer(F.col("response")), "__g": short_answer(F.col("gold"))})
    found = plain.withColumn("__at", F.instr(F.concat(F.lit(" "), F.col("__r"), F.lit(" ")), F.concat(F.lit(" "), F.col("__g"), F.lit(" "))) - 1)
    r, g, at = F.col("__r"), F.col("__g"), F.col("__at")
    found = found.withColumn("__inside", (g != "") & (at >= 0) & ~negated_before(r, at))
    text, inside = F.trim("response"), F.col("__inside")
    cases = [
        ("routing_override", "routing_override", routing_override(F.col("decision"))),
        ("incorrect", "empty_response", text.isNull() | (text == "")),
        ("abstain", "abstain_detected", F.lower(text).rlike("|".join(abstain))),
        ("correct", "exact_normalized", (g != "") & (r == g)),
        ("judge_review", "short_gold_late_match", inside & (F.length(g) <= 3) & (at >= 50)),
        ("correct", "substring", inside),
        ("judge_review", "verbose_with_single_token_gold", (F.length(text) > 100) & ~F.contains(F.trim("gold"), F.lit(" "))),
    ]
    verdict, layer = F.lit("incorrect"), F.lit("no_match")
    for v, name, test in reversed(cases):
        verdict, layer = F.when(test, v).otherwise(verdict), F.when(test, name).otherwise(layer)
    return found.select(*replies.columns, verdict.alias("verdict"), layer.alias("layer"))


def tags_in_order(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))


def term_hits(text: Column, terms: Column) -> Column:
    """The terms that occur in the text."""
    return F.filter(terms, lambda t: F.contains(F.lower(text), F.lower(t)))


def window_hits(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """Distinct (doc_id, item_id) where n words in a row of an item, lower-cased, stand in a document.

    An item of fewer words counts where all of it stands. Windows of both sides meet on 128
    bits of hashes, an equi-join for each length of an item under n words, and one for n; each
    side has a window once for each text. Repeated white space is one space, words lie between.
    """
    flat = lambda df, key: df.select(key, F.regexp_replace(F.lower("text"), r"\s+", " ").alias("t"))
    left, right = flat(docs, "doc_id"), flat(items, "item_id").withColumn("words", F.size(F.split("t", " ")))

    def windows(df: DataFrame, key: str, length: int) -> DataFrame:
        # At each start of a word it looks ahead, so the time follows the length of the text.
        found = F.array_distinct(F.regexp_extract_all("t", F.lit(rf"(?<![^ ])(?=([^ ]*(?: [^ ]*){{{length - 1}}})(?![^ ]))"), 1))
        return df.select(key, F.explode(found).alias("g")).select(key, F.xxhash64("g").alias("a"), F.xxhash64(F.lit(1), "g").alias("b"))

    # At most n numbers.
    lengths = sorted(r["n"] for r in right.select(F.least("words", F.lit(n)).alias("n")).filter("n > 0").distinct().collect())
    found = None
    for length in lengths:
        own = right if length == n else right.filter(F.col("words") == length)
        hits = windows(left, "doc_id", length).join(windows(own, "item_id", length), ["a", "b"]).select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    return left.join(right.limit(0), F.lit(False)).select("doc_id", "item_id") if found is None else found.distinct()


def reply_language(text: Column) -> Column:
    """ja with any kana, else zh with any Han character, else en; unknown without text."""
    return F.when(text.isNull() | (text == ""), "unknown").when(text.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").otherwise("en")


def fabricated_phrases(response: Column, query: Column, most: int = 8) -> Column:
    """Capitalised phrases of the response that the query lacks, each once, in order."""
    found = F.regexp_extract_all(response, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda p: ~F.contains(F.lower(query), F.lower(p)))), 1, most)


def scrubbed(text: Column) -> Column:
    """Secrets replaced: keys with known prefixes and quoted tokens."""
    return F.regexp_replace(F.regexp_replace(text, r"(gsk_|sk-|ghp_)[A-Za-z0-9_-]{8,}", "[secret]"), r'token = "[^"]*"', 'token = "[secret]"')


def fingerprint(value: Column, digits: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, digits)


def grammar_prefixed(text: Column, as_of: Column, marker: str = "[As of") -> Column:
    """The text with a date bound in front, unless it bears one."""
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(F.lit("[As of "), as_of, F.lit("] "), text))
