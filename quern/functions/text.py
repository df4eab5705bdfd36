"""Text columns: normal forms, fingerprints, numbers in text, references, quotes. Built-in functions unless a docstring says so.

The normal forms differ on purpose: what is noise for one comparison is content for another.
White space is always spelled out, as engines disagree about it: ``SPACE`` is ASCII white space, every separator and U+FEFF.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

SPACE = r"\s\p{Z}\x{FEFF}"


def _each(f, kind: str = "string"):
    """A pandas UDF that applies f to every non-null value."""

    @F.pandas_udf(kind)
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else f(x))

    return apply


def nfkc(text: Column) -> Column:
    """Compatibility composition, which Spark lacks; Arrow batches. ASCII goes through unchanged."""
    return _each(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t))(text)


def unescape_html(text: Column) -> Column:
    return _each(lambda t: html.unescape(t) if "&" in t else t)(text)


def _text(text: Column, compose: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    return nfkc(text) if compose else text


def content_form(text: Column, compose: bool = False) -> Column:
    """For duplicates: without punctuation, white space and underscores, lower case. Symbols stay (a x b is not a / b)."""
    return F.lower(F.regexp_replace(_text(text, compose), rf"[\p{{P}}{SPACE}_]+", ""))


def quote_form(text: Column, compose: bool = False) -> Column:
    """For quotes: without punctuation, white space, other symbols, private use and geometric shapes; case and maths signs stay."""
    return F.regexp_replace(_text(text, compose), rf"[\p{{P}}{SPACE}\p{{So}}\p{{Co}}\x{{25A0}}-\x{{25FF}}]+", "")


def listed_form(text: Column, signs: str, compose: bool = False) -> Column:
    """Without white space and a stated list of signs."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in signs)
    return F.regexp_replace(_text(text, compose), rf"[{SPACE}{quoted}]+", "")


def tag_form(tag: Column) -> Column:
    """For topic tags: lower case, without white space, CJK signs, full-width forms and common ASCII signs."""
    return F.regexp_replace(F.lower(tag), r"[\s\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\-_/.,:;()\[\]]+", "")


def folded(text: Column, pairs: dict[str, str], compose: bool = False) -> Column:
    """Variant characters folded by a stated table, then the quote form."""
    return quote_form(F.translate(_text(text, compose), "".join(pairs), "".join(pairs.values())))


def content_signature(stem: Column, options: Column, compose: bool = False) -> Column:
    """Equal for equal contents whatever the order of options. options: array<string>. The key of duplicate joins; hash it."""
    if compose:
        return F.concat(content_form(stem, True), F.lit("||"), F.array_join(F.array_sort(F.transform(F.split(nfkc(F.array_join(F.coalesce(options, F.array().cast("array<string>")), "\x01")), "\x01"), lambda x: content_form(x))), "|"))
    return F.concat(content_form(stem), F.lit("||"), F.array_join(F.array_sort(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda x: content_form(x))), "|"))


def numbers(text: Column) -> Column:
    """array<double>: distinct numbers of a text, ascending; thousands' commas are dropped."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,\x{FF0C}]", ""), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("double"))))


def plain_number(x: Column) -> Column:
    """A double without needless zeros: 0.50 is 0.5, 500000.0 is 500000."""
    return F.regexp_replace(x.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")


#: What a number and the operators between numbers are written with.
NUMBER_SIGNS = "0123456789.,，+-−×÷*/=()（）±≥≤<>~～"


def is_numeric_text(text: Column, units: tuple[str, ...] = ("%", "kg", "km", "kWh")) -> Column:
    """Whether nothing is left without units (first, longest first), digits, separators and operators."""
    rest = F.coalesce(text, F.lit(""))
    if units:
        rest = F.regexp_replace(rest, "|".join("\\Q" + u + "\\E" for u in sorted(units, key=lambda u: (-len(u), u))), "")
    return F.length(F.regexp_replace(rest, f"[{SPACE}{re.escape(NUMBER_SIGNS)}]+", "")) == 0


def calc_signature(stem: Column, options: Column, units: tuple[str, ...] = ("%", "kg", "km", "kWh")) -> Column:
    """Equal for questions with the same numbers however they are worded; null unless every option is numeric and the stem has
    two distinct numbers."""
    shown = lambda x: F.array_join(F.transform(numbers(x), plain_number), ",")
    whole = (F.size(options) > 0) & F.forall(options, lambda o: is_numeric_text(o, units)) & (F.size(numbers(stem)) >= 2)
    return F.when(whole, F.concat(shown(stem), F.lit("||"), F.array_join(F.array_sort(F.transform(options, shown)), ";")))


def option_value(text: Column) -> Column:
    """The value of a difference times one or two factors, (a - b) x c [x d], else of the only number, else null."""
    s = F.translate(F.regexp_replace(text, f"[,，{SPACE}]+", ""), "−×x", "-**")
    # The term as its numbers and signs: the difference first, then what it is multiplied by.
    term = F.regexp_extract(s, r"\(?([0-9.]+-[0-9.]+)\)?\*[0-9.]+(?:\*[0-9.]+)?", 0)
    sides = F.split(F.translate(term, "()", ""), r"\*")
    ends = F.transform(F.split(sides[0], "-"), lambda x: x.try_cast("double"))
    factors = F.aggregate(F.slice(sides, 2, F.size(sides) - 1), F.lit(1.0), lambda a, x: a * F.coalesce(x.try_cast("double"), F.lit(1.0)))
    alone = F.regexp_extract_all(s, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    return F.when(term != "", (F.try_element_at(ends, F.lit(1)) - F.try_element_at(ends, F.lit(2))) * factors).when(F.size(alone) == 1, F.try_element_at(alone, F.lit(1)).try_cast("double"))


def common_prefix(options: Column) -> Column:
    """The longest common prefix of an array<string>: that of its least and greatest element."""
    low, high = F.array_min(options), F.array_max(options)
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.substring(low, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))


def redundant_prefix(stem: Column, options: Column, separators: str = ":,;") -> Column:
    """What all options (two at least, none empty or led by a separator) begin with, if the stem has it too; else null. Without
    separators at its end, two characters at least, and no whole option."""
    sign = "[" + "".join("\\" + c for c in separators) + r"\s]"
    cut = F.regexp_replace(common_prefix(options), sign + "+$", "")
    sound = (F.size(options) >= 2) & F.forall(options, lambda o: (F.length(F.trim(o)) > 0) & ~F.regexp_like(o, F.lit("^" + sign)))
    return F.when(sound & (F.length(cut) >= 2) & ~F.exists(options, lambda o: F.trim(o) == cut) & F.contains(stem, cut), cut)


def joined_lines(text: Column) -> Column:
    """Wrapped lines joined: no space where either side is a CJK character, else one."""
    wide = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{3000}-\x{303F}"
    t = F.regexp_replace(text, rf"(?<=[{wide}])\s*\n\s*|\s*\n\s*(?=[{wide}])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s*\n\s*", " "), r"[ \t]+", " "))


def item_hash(stem: Column, options: Column) -> Column:
    """Fixity: sha256 of the stem without white space, ``||`` and ``key:text`` of the options by key. options: array<struct<key,text>>."""
    parts = F.transform(F.array_sort(options), lambda o: F.concat(o["key"], F.lit(":"), F.regexp_replace(o["text"], r"[ \t\n\x0B\f\r]+", "")))
    return F.sha2(F.concat(F.regexp_replace(stem, rf"[{SPACE}]+", ""), F.lit("||"), F.array_join(parts, "|")), 256)


def corpus_hash(number: Column, text: Column) -> Column:
    """Aggregate: sha256 over the lines ``number<TAB>text``, sorted. For corpora of bounded groups (one law, one manual)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(number, F.lit("\t"), text))), "\n"), 256)


#: How Chinese explanations name options. Words before a letter and what may link them, signs between the letters of a list,
#: verbs after a letter that is a subject and before one that is an object, and names that end in a letter without naming an option.
CHINESE_LETTERS = {
    "words": ("選項", "答案", "正解", "正確答案", "標準答案", "應選", "故選", "本題答案", "此題答案"),
    "links": ("為", "是", "應為", "即", "：", ":"),
    "joins": "、,，/／與和及",
    "verbs": ("屬", "是", "為", "則", "皆", "都"),
    "before": ("說", "選", "把", "指"),
    "names": ("費率",),
}


def letter_references(text: Column, words: tuple[str, ...] = ("answer", "option", "choice"), joins: str = ",/&", verbs: tuple[str, ...] = ("is", "was", "are"), links: tuple[str, ...] = ("is", ":"), before: tuple[str, ...] = ("choose", "pick"), names: tuple[str, ...] = ("rate",)) -> Column:
    """array<string>: at most one hit a pattern: a word then a letter A to D; a list of letters; a letter as subject (before one of ``verbs``) or
    object (after one of ``before``). A letter that ends one of ``names`` (a rate called A) or a number with its unit (1.5 °C) is none."""
    any_of = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
    whole = lambda xs: "|".join(rf"\b{re.escape(x)}\b" if x.isascii() else re.escape(x) for x in xs)
    degree = r"\x{00B0}"
    spared = "".join(rf"(?<!{re.escape(n)})(?<!{re.escape(n)}\s)" for n in names)
    after = rf"(?<=(?:{whole(before)}))\s*[A-D](?![A-Za-z0-9{degree}])"
    subject = rf"(?<![A-Za-z0-9{degree}$]){spared}[A-D]\s*(?={whole(verbs)})"
    patterns = [
        rf"(?i:{any_of(words)})\s*(?i:{any_of(links)})?\s*[（(]?\s*[A-D]\s*[）)]?(?![A-Za-z0-9_])",
        rf"(?<![A-Za-z0-9])[A-D]\s*[{joins}]\s*[A-D](?:\s*[{joins}]\s*[A-D])*(?![A-Za-z0-9])",
        f"(?:{after}|{subject})",
    ]
    hits = F.array(*(F.regexp_extract(F.coalesce(text, F.lit("")), p, 0) for p in patterns))
    return F.filter(hits, lambda h: h != "")


def letters_agree(text: Column, answer: Column, word: str = "answer") -> Column:
    """Whether all letters that the text names after the word are the answer; null where it names none."""
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i:{word})\s*(?i:is|:)?\s*\(?([A-D])\)?(?![A-Za-z0-9_])"), 1))
    return F.when(F.size(named) > 0, (F.size(named) == 1) & (F.try_element_at(named, F.lit(1)) == answer))


def has_bracket_citation(text: Column) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r"\[[0-9]+(?:\s*,\s*[0-9]+)*\]"))


def urls_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s)\]>\"']+"), 0))


def undeclared_urls(text: Column, declared: Column) -> Column:
    return F.array_except(urls_in(text), F.coalesce(declared, F.array().cast("array<string>")))


#: Kinds of claims and what they look like without white space; numeric kinds also count as supported where just their
#: number (of two digits at least) occurs.
CLAIMS = {
    "article": (r"第[0-9一二三四五六七八九十百]+[條項款目]", False),
    "article sign": (r"§[0-9]+(?:[-–.][0-9]+)*", False),
    "section": (r"(?i:article|art\.|para\.?|section)[0-9]+", False),
    "standard": (r"(?i:iso)[0-9]{4,5}(?:[-–][0-9]+)?|(?i:ifrss)[0-9]|(?i:pas)[0-9]{4}", False),
    "regulation": (r"(?i:eu|ec)[0-9]{4}/[0-9]{2,4}", False),
    "appendix": (r"(?i:appendix|annex)[A-Za-z0-9]+|附[錄件表][一二三四五六七八九十0-9A-Za-z]+", False),
    "percent": (r"[0-9]+(?:\.[0-9]+)?%", True),
    "year": (r"(?:19|20)[0-9]{2}年?", True),
    "amount": (r"[0-9][0-9,.]*(?:公噸|噸|萬|億|元|公斤|(?i:gw|mw|kg|tco2e))", True),
}


def _unsupported(found: Column, kind: str, numeric: bool, source: Column) -> Column:
    def missing(c):
        digits = F.regexp_replace(c, "[^0-9.]+", "")
        near = (F.length(digits) >= 2) & F.contains(source, digits) if numeric else F.lit(False)
        return ~(F.contains(source, c) | near)

    return F.transform(F.filter(found, missing), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("claim")))


def unsupported_claims(text: Column, allowed: Column, kinds: dict[str, tuple[str, bool]] = CLAIMS, compose: bool = False) -> Column:
    """array<struct<kind, claim>>: claims of a text that none of the allowed texts (array<string>) holds; without white space, and
    if ``compose`` with full-width forms as plain ones."""
    flat = lambda t: F.regexp_replace(_text(t, compose), rf"[{SPACE}]+", "")
    source = flat(F.array_join(F.filter(allowed, lambda a: a.isNotNull()), " "))
    claims = lambda both, pattern: F.array_distinct(F.regexp_extract_all(both["text"], F.lit(f"({pattern})"), 1))
    # Both texts are made once and then named, so that the functions over their claims hold no Python.
    once = F.array(F.struct(flat(text).alias("text"), source.alias("source")))
    return F.flatten(F.transform(once, lambda both: F.concat(*(_unsupported(claims(both, p), kind, numeric, both["source"]) for kind, (p, numeric) in kinds.items()))))


def confidence(text: Column, keywords: tuple[str, ...], unsure: tuple[str, ...] = ("not sure", "cannot determine")) -> Column:
    """0.3 below 50 characters; else 0.5, + 0.15 for 80 to 1500, + 0.1 for naming A and B, + 0.03 a keyword up to 0.25, - 0.15
    where unsure; between 0 and 1."""
    n = F.length(text)
    hits = sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
    doubt = F.lit(False)
    for u in unsure:
        doubt = doubt | F.contains(text, F.lit(u))
    s = F.lit(0.5) + F.when(n.between(80, 1500), 0.15).otherwise(0.0) + F.when(F.contains(text, F.lit("A")) & F.contains(text, F.lit("B")), 0.1).otherwise(0.0) + F.least(hits * 0.03, F.lit(0.25)) - F.when(doubt, 0.15).otherwise(0.0)
    return F.when(text.isNull() | (n < 50), F.lit(0.3)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def fragments_present(quote: Column, body: Column, least: int = 8, cuts: str = r"[、，。；：…\n\r]+|\.{3}") -> Column:
    """Whether the quote, cut at these signs, has long enough fragments (in quote form) and all of them are in the body, in any
    order: true to the source, though not word for word."""
    parts = F.filter(F.transform(F.split(quote, cuts), lambda x: quote_form(x)), lambda x: F.length(x) >= least)
    page = quote_form(body)
    return F.coalesce((F.size(parts) > 0) & F.forall(parts, lambda x: F.contains(page, x)), F.lit(False))


def mentioned(text: Column, aliases: dict[str, str]) -> Column:
    """array<string>: the codes of all aliases that a text mentions (alias -> code), distinct, in the aliases' order."""
    found = F.array(*(F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(a)), F.lit(c)) for a, c in aliases.items())) if aliases else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(found))


def article_references(text: Column, aliases: dict[str, str]) -> Column:
    """array<struct<code, article>>: references like ``<alias> 第 12 條`` (digits or Chinese numerals) or ``<alias> § 12``; the alias
    may stand in double angle brackets. Longer aliases first."""
    names = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    pattern = rf"《?({names})》?\s*(?:第\s*([0-9一二三四五六七八九十]+)\s*條|§\s*([0-9]+))"
    groups = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), i) for i in (1, 2, 3)]
    code = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    number = lambda x: F.when((x["1"] != "") & F.regexp_like(x["1"], F.lit("^[0-9]+$")), x["1"]).when(x["1"] != "", chinese_number(x["1"]).cast("string")).otherwise(x["2"])
    return F.transform(F.arrays_zip(*(g.alias(str(i)) for i, g in enumerate(groups))), lambda x: F.struct(F.element_at(code, x["0"]).alias("code"), number(x).alias("article")))


def law_quotes(text: Column, aliases: dict[str, str], least: int = 16, clause: str = "[，；]", share: float = 0.5) -> Column:
    """array<struct<code, quote>>: what a text quotes as a law's wording, for every law (alias -> code) that it mentions: between corner brackets, of
    ``least`` characters, with a sign that parts clauses, and at least this share of them ideographs. Shorter or unbroken quotes are mostly terms and titles."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[「『]([^」』]+)[」』]"), 1)
    ideographs = lambda q: F.length(F.regexp_replace(q, r"[^\x{4E00}-\x{9FFF}]", ""))
    kept = F.filter(found, lambda q: (F.length(q) >= least) & F.regexp_like(q, F.lit(clause)) & (ideographs(q) >= F.length(q) * share))
    return F.flatten(F.transform(kept, lambda q: F.transform(mentioned(text, aliases), lambda c: F.struct(c.alias("code"), q.alias("quote")))))


def quotes_in(text: Column, opening: str = "「", closing: str = "」", least: int = 16) -> Column:
    """array<string>: what stands between quotation marks and is long enough."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{opening}([^{opening}{closing}]*){closing}"), 1), lambda q: F.length(q) >= least)


def is_verbatim(quote: Column, body: Column, least: int = 6, cuts: str = r"\x{2026}+|\.\.\.|\x{3001}|\x{FF1B}|;|\x{2014}+") -> Column:
    """Whether every fragment of the quote (cut at ellipses and such; in quote form; long enough) is in the body. Without a
    fragment, the whole quote."""
    parts = F.filter(F.transform(F.split(quote, cuts), lambda x: quote_form(x)), lambda x: F.length(x) >= least)
    page = quote_form(body)
    return F.when(F.size(parts) > 0, F.forall(parts, lambda x: F.contains(page, x))).otherwise(F.contains(page, quote_form(quote)) & (F.length(quote_form(quote)) > 0))


class Passages:
    """The places of a page's windows of ``least`` characters, from which runs of it are followed."""

    def __init__(self, page: str, least: int = 12):
        self.page, self.least, self.places = page, least, {}
        for i in range(len(page) - least + 1):
            self.places.setdefault(page[i : i + least], []).append(i)

    def run(self, text: str) -> int:
        """How many characters of the text's beginning stand in the page, if there are ``least`` at least; else 0."""
        longest = 0
        for place in self.places.get(text[: self.least], ()):
            n = self.least
            while n < len(text) and self.page[place + n : place + n + 1] == text[n]:
                n += 1
            longest = max(longest, n)
        return longest

    def splice(self, text: str, most: int = 4) -> bool:
        """Whether a text is at most ``most`` longest runs of the page, one after the other. Only the last may be short."""
        for _ in range(most):
            if len(text) < self.least:
                return bool(text) and text in self.page
            n = self.run(text)
            if not n:
                return False
            text = text[n:]
            if not text:
                return True
        return False


def spliced(quote: str, page: str, least: int = 12, most: int = 4) -> bool:
    return Passages(page, least).splice(quote, most)


def quote_status(quote: Column, page: Column) -> Column:
    """'verbatim', 'reordered' (spliced from few runs of the page) or 'absent'; both in quote form here. Arrow for the splices."""
    q, p = quote_form(quote), quote_form(page)

    @F.pandas_udf("boolean")
    def splices(a: pd.Series, b: pd.Series) -> pd.Series:
        out, pages = [], {}
        for x, y in zip(a, b):
            if not x or y is None or x in y:
                out.append(False)
                continue
            if y not in pages:  # the quotes of a page mostly follow one another
                pages = {y: Passages(y)}
            out.append(pages[y].splice(x))
        return pd.Series(out, dtype=bool)

    return F.when(F.length(q) == 0, "absent").when(F.contains(p, q), "verbatim").when(splices(q, p), "reordered").otherwise("absent")


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, as Python's difflib gives it (junk heuristic from 200 characters on). Arrow."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)], dtype=float)

    return ratio(a, b)


#: Digits and the ten of Chinese numerals up to 99.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TEN = "十"


def chinese_number(text: Column) -> Column:
    """1 to 99 from Chinese numerals; null for anything else."""
    digit = lambda c: F.coalesce(*(F.when(c == k, v) for k, v in NUMERALS.items()))
    one = "[" + "".join(NUMERALS) + "]"
    head, tail = F.regexp_extract(text, f"^({one}?){TEN}", 1), F.regexp_extract(text, f"{TEN}({one}?)$", 1)
    tens = F.when(head == "", 1).otherwise(digit(head)) * 10 + F.when(tail == "", 0).otherwise(digit(tail))
    return F.when(F.regexp_like(text, F.lit(f"^{one}$")), digit(text)).when(F.regexp_like(text, F.lit(f"^{one}?{TEN}{one}?$")), tens)
