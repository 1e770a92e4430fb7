"""Repair of text from scanned pages: page furniture, words divided for the layout, misread characters.

The order of the work:

1. A document is a scan if its rows show page numbers, repeated headers or words
   divided at line ends; one small aggregation by document.
2. One pass over the rows counts words, numbers and character trigrams, apart
   for scans and other documents, inside each task; only distinct terms are
   shuffled. The terms of the other documents are the vocabulary.
3. The distinct terms of scans that the vocabulary lacks are intersected, as
   Levenshtein automata, with vocabulary tries, in shards of bounded size; all
   terms within the distance come out, and those whose difference is one of
   characters drawn alike are kept.
4. A second pass looks the misread terms up again in the rows through a bitmap
   of fixed size, which loses none; an exact join takes out its false hits.
   Candidates are ranked by the vocabulary's word pairs around each place.
5. For repaired text, the corrections of a row are applied, the furniture is
   dropped and the lines are joined to paragraphs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.llm.automata import Trie
from lathework.session import written

# Characters that recognition takes for one another, each group by its first member; then letters by the groups they are drawn like.
DRAWN_ALIKE = ["li1|!íìj", "o0óòöq", "ceéè", "tf", "hb86", "s5", "g9", "z2", "aàáä"]
DRAWN_AS_PAIR = {"u": "ll", "v": "ll", "ü": "ll", "w": "llll", "m": "rn", "d": "cl"}
# Letters taken for digits.
AS_DIGIT = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "|": "1", "i": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9", "b": "6", "G": "6", "A": "4", "T": "7"}
# Words before a page number.
PAGE_WORDS = "page pages pag página pág seite s p pp стр страница strona side sida blz".split()
PAGE_OF = "of von de из sur di av".split()

#: Least and most bits of the bitmap of misread terms; the most are 32 MB.
BITMAP_BITS = 1 << 22, 1 << 28
#: How many times rarer than its candidate a misreading is in clean text at least, and how many times more frequent, beside its candidate, in scans.
RARER, OFTENER = 20, 3

_IDEO = r"\u3005\u3007\u3041-\u3096\u30a1-\u30fa\u30fc\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"
_ALNUM, _LETTER = rf"[^\W_{_IDEO}\u0e00-\u0e7f]", rf"[^\W\d_{_IDEO}\u0e00-\u0e7f]"
LINE = re.compile(r"\n")
TOKEN = re.compile(rf"{_ALNUM}+(?:[-_/.·'’\u2011]{_ALNUM}+)*")
IDEOGRAPH = re.compile(f"[{_IDEO}]")
UNSPACED = re.compile(f"[{_IDEO}\u0e01-\u0e4e]")
LETTER = re.compile(_LETTER)
MIXED = re.compile(rf"\d[OoQDlI|SsBZzgqbGA]|(?<!{_LETTER})[OoQlI|SsBZzgqbG]{{1,3}}\d|\d{_LETTER}{{1,2}}\d|{_LETTER}{{2}}\d|{_LETTER}\d{_LETTER}|\d{_LETTER}{{3}}|(?<!\d)\d[a-zà-ÿ]{{2}}")
DIGITS = re.compile(r"\d+")
HYPHENS = "-\u2010\u00ad¬"
DIVIDED = re.compile(rf"({_LETTER}(?:{_ALNUM}|['’])*(?:-{_ALNUM}+)*)([{HYPHENS}])\s*\Z")
FIRST_WORD = re.compile(rf"\s*((?:{_ALNUM}|['’])+)")
NUMBER = r"[\dOolI|SsBZgqb]{1,6}"
_HAN = r"[\u3400-\u9fff]"
PAGE_FORMS = re.compile(
    rf"(?:[-–—·•\[(|]\s*{NUMBER}\s*[-–—·•\])|]|{NUMBER}\s*/\s*{NUMBER}|第\s*{NUMBER}\s*{_HAN}(?:\s*共\s*{NUMBER}\s*{_HAN})?|{_HAN}\s*{NUMBER}\s*[页頁](?:\s*{_HAN}\s*{NUMBER}\s*{_HAN})?|{NUMBER}\s*ページ)"
)
PAGE_NAMED = re.compile(rf"([^\W\d_]\w*)\.?\s*({NUMBER})(?:\s*([^\W\d_]+|[^\W\d_]?[\dl][^\W\d_]?|/)\s*({NUMBER}))?")
BARE = re.compile(NUMBER)
NUMBERISH = re.compile(r"[\dlIO|]")
UNIT_HEAD = re.compile(r"[(（][^()（）]{1,10}[)）]\s*[:：]?\s*\Z")
AROUND_TITLE = re.compile(rf"\A\s*(?:{NUMBER}\s*[|｜]\s*)?(?:[^—|]{{1,40}}\s—\s)?|\s+[·•]\s+[^\W\d_]{{2,4}}\.?\s+[\d.OolI|SsBZgqb]+(?=\s|\Z)|(?:\s{{2,}}|\s*[|｜]\s*){NUMBER}\s*\Z")
PARAGRAPH_START = re.compile(r"\s*(?:[-–•*]\s|\(?\d{1,3}[.)]\s)")
_TO_CLASS = str.maketrans({c: g[0] for g in DRAWN_ALIKE for c in g} | DRAWN_AS_PAIR)
_AS_ZERO = str.maketrans({c: "0" for c in "0123456789０１２３４５６７８９"})


def fold(s: str) -> str:
    """``s`` with everything that recognition confuses made equal."""
    return s.lower().translate(_TO_CLASS)


def fold_column(c: Column) -> Column:
    """:func:`fold` of a column."""
    c = F.lower(c)
    for k, v in DRAWN_AS_PAIR.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join(DRAWN_ALIKE), "".join(g[0] * len(g) for g in DRAWN_ALIKE))


def most_edits(length: int) -> int:
    """Largest edit distance of a candidate, by the length of the word: half of it, and 1 up to four letters."""
    return length // 2 if length > 4 else 1


@lru_cache(10_000)
def folded_title(title: str | None) -> tuple[str, tuple[str, ...]]:
    """The folded title, and three parts of it of which one is whole wherever at most two characters differ."""
    f = fold(title.strip()) if title else ""
    k = -(-len(f) // 3)
    return f, tuple(f[x : x + k] for x in range(0, len(f), max(1, k)))


def mask(token: str) -> str:
    """``token`` with every run of digits as 0."""
    return DIGITS.sub("0", token)


def near(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


_PAGE_FOLDED, _OF_FOLDED = {fold(w) for w in PAGE_WORDS}, {fold(w) for w in PAGE_OF}


def _is_number(s: str) -> bool:
    return any(c.isdigit() for c in s) or len(s) <= 3 and all(c in "lIO|" for c in s)


def page_number(s: str) -> bool:
    """Whether the stripped line is a page number in a form that shows it as one."""
    if PAGE_FORMS.fullmatch(s):
        return any(c.isdigit() or c in "lIOSB" for c in s)
    m = PAGE_NAMED.fullmatch(s)
    return bool(m and fold(m[1]) in _PAGE_FOLDED and _is_number(m[2]) and (m[3] is None or m[3] == "/" or fold(m[3]) in _OF_FOLDED and _is_number(m[4])))


def names_document(s: str, title: str | None) -> bool:
    """Whether the stripped line is the title, alone or between page number, maker and revision."""
    whole, parts = folded_title(title)
    if not whole or len(s) > len(whole) + 70:
        return False
    f = fold(s)
    if len(f) + 3 < len(whole) or not any(p in f for p in parts):
        return False
    most = 1 if len(whole) < 12 else 2
    core = s
    for _ in range(3):
        f = fold(core)
        if f == whole or near(f, whole, most):
            return True
        cut = AROUND_TITLE.sub("", core).strip()
        if cut == core:
            return False
        core = cut
    return False


def line_kinds(lines: list[str], title: str | None) -> list[str]:
    """For every line '', 'page_number' or 'running_header'."""
    kinds = []
    measured = False
    for line in lines:
        s = line.strip()
        kind = ""
        if s:
            short = len(s) <= 32 and NUMBERISH.search(s)
            if short and len(s) <= 6 and BARE.fullmatch(s) and _is_number(s):
                kind = "" if measured else "page_number"
            elif short and page_number(s):
                kind = "page_number"
            else:
                kind = "running_header" if names_document(s, title) else ""
                measured = s[-1] in ")）:：" and UNIT_HEAD.search(s) is not None
        kinds.append(kind)
    return kinds


def divided_at_end(line: str):
    """The word divided at the end of ``line`` as a match, or None."""
    s = line.rstrip()
    return DIVIDED.search(line) if s and s[-1] in HYPHENS else None


def shows_scan(text: str, title: str | None) -> int:
    """Signs of a scan in ``text``: page numbers, titles beside or below other text, words divided at line ends."""
    lines = LINE.split(text)
    kinds = line_kinds(lines, title)
    signs = 0
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "page_number" or kind and (i > 0 or fold(line.strip()) != folded_title(title)[0]):
            signs += 1
        elif not kind and i + 1 < len(lines) and (m := divided_at_end(line)) and m[1][-1].islower() and m[2] != "-":
            following = next((x for x, k in zip(lines[i + 1 :], kinds[i + 1 :]) if x.strip() and not k), "")
            signs += following[:1].islower()
    return signs


class Run:
    """The characters of the lines with ideographs as one run: digits as 0, other letters as a."""

    def __init__(self):
        self.pieces: list[str] = []
        self.starts: list[int] = []
        self.origins: list[tuple[int, int]] = []
        self.length = 0

    def add(self, piece: str, line: int, at: int) -> None:
        self.pieces.append(piece)
        self.starts.append(self.length)
        self.origins.append((line, at))
        self.length += len(piece)

    def trigrams(self) -> Iterator[tuple[str, str, int]]:
        """(kind, trigram, place of the character meant): c inside, e and f at the first and last character of a stretch."""
        t = LETTER.sub("a", "".join(self.pieces)).translate(_AS_ZERO)
        last = len(t) - 1
        for m in UNSPACED.finditer(t):
            x = m.start()
            if x == 0 or t[x - 1] == "\n":
                if x + 2 <= last:
                    yield "e", t[x : x + 3], x
            elif x == last or t[x + 1] == "\n":
                if x >= 2:
                    yield "f", t[x - 2 : x + 1], x
            else:
                yield "c", t[x - 1 : x + 2], x

    def origin(self, x: int) -> tuple[int, int]:
        k = bisect_right(self.starts, x) - 1
        line, at = self.origins[k]
        return line, at + x - self.starts[k]


def terms(text: str, kinds: list[str] | None, scan: bool) -> tuple[list[tuple], Run]:
    """All terms of a text outside its furniture (``kinds`` by line): (kind, term, line, at, raw, before, after, line2), and the run of characters of unspaced scripts.

    Kinds: w word in lower case; d digits with letters, as written; m masked
    number; n masked number or single letter with the next word; b pair of words;
    p first part of a compound; h word divided at a line end, with its rest in line2.
    """
    lines = LINE.split(text)
    body = [i for i in range(len(lines)) if not kinds or not kinds[i]]
    rest_at: dict[int, int] = {}  # lines that begin with the rest of a divided word, and where the text after it begins
    wraps_anywhere = IDEOGRAPH.search(text) is not None  # lines of such scripts also end within identifiers
    unspaced = UNSPACED.search(text) is not None
    run = Run()
    out: list[tuple] = []
    add = out.append
    previous = ""
    for k, i in enumerate(body):
        line = lines[i]
        start, stop = rest_at.get(i, 0), len(line)
        divided = divided_at_end(line)
        if divided and divided.start() >= start:
            nxt = next((j for j in body[k + 1 :] if lines[j].strip()), -1)
            m = FIRST_WORD.match(lines[nxt]) if nxt >= 0 else None
            rest, left, mark = m[1] if m else "", divided[1], divided[2]
            inside = left[-1].islower() or left[-1].isdigit() and sum(map(str.islower, left)) > 1
            if inside and (not rest or rest[0].islower() or rest[0].isdigit() and not rest.isdigit()) or mark != "-":
                add(("h", f"{left.lower()}{mark}{rest.lower()}", i, divided.start(), left, previous, rest, nxt))
                if rest:
                    rest_at[nxt] = m.end()
                stop = divided.start()
        found = [(m.group(), m.start()) for m in TOKEN.finditer(line, start, stop)]
        for a, (raw, at) in enumerate(found):
            after = found[a + 1][0].lower() if a + 1 < len(found) else ""
            if raw.isalpha() or not DIGITS.search(raw):
                word = raw.lower()
                if len(raw) == 1 or len(raw) <= 3 and not raw.strip("lIO"):
                    add(("n", f"{raw}|{mask(after)}", i, at, raw, previous, after, -1))
                if len(raw) > 1:
                    add(("w", word, i, at, raw, previous, after, -1))
                    if previous and not scan:
                        add(("b", f"{previous} {word}", i, at, raw, "", "", -1))
                    if "-" in word:
                        add(("p", word[: word.rindex("-") + 1], i, at, raw, "", "", -1))
                        for part in word.split("-"):
                            add(("w", part, i, at, raw, "", "", -1))
                previous = word
            else:
                add(("m", mask(raw), i, at, raw, "", "", -1))
                if not scan and len(raw) > 4 and not raw.isalnum():
                    for part in re.split(r"[\W_]", raw):
                        add(("m", mask(part), i, at, raw, "", "", -1))
                if after and raw.isdigit():
                    add(("N", "0|" + mask(after), i, at, raw, "", "", -1))
                cut = wraps_anywhere and (at == 0 and k > 0 or at + len(raw) == stop and i < body[-1])
                if not cut and MIXED.search(raw):
                    add(("d", raw, i, at, raw, previous, after, -1))
                previous = ""
        if unspaced and UNSPACED.search(line):
            piece = line[start:stop]
            run.add(piece.strip(), i, start + len(piece) - len(piece.lstrip()))
        elif line.strip():
            run.add("\n", i, 0)
    return out, run


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the terms of a task's rows, apart for scans; given out whenever many have gathered."""
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(k, t, 0 if s else n, n if s else 0) for (s, k, t), n in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["kind", "term", "c", "s"])

    for batch in batches:
        for text, title, scan in zip(batch["text"], batch["title"], batch["scan"]):
            scan = bool(scan)
            found, run = terms(text, line_kinds(LINE.split(text), title) if scan else None, scan)
            only = "wdmnNh" if scan else "wmnNbph"
            counts.update([(scan, x[0].lower(), x[1]) for x in found if x[0] in only])
            counts.update([(scan, kind, t) for kind, t, _ in run.trigrams() if scan or kind == "c"])
        if len(counts) > 300_000:
            yield out()
    yield out()


def candidates(key, vocabulary: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """For one shard: of each segment, the vocabulary's terms within the distance of the queries that share it.

    Segments = hold what a term is drawn like, so the distance may be half the word and the automaton
    follows only letters drawn like the query's; all others hold a piece that a single edit leaves whole.
    """
    found = []
    words = {k: g["term"] for k, g in vocabulary.groupby("segment")}
    for segment, asked in queries.groupby("segment"):
        if segment in words:
            trie, alike = Trie(words[segment]), segment[0] == "="
            for q in asked["term"]:
                found.extend((q, t, d, alike or fold(q) == fold(t)) for t, d in (trie.within(q, most_edits(len(q)), fold) if alike else trie.within(q, 1)) if d)
    return pd.DataFrame(found, columns=["term", "candidate", "distance", "alike"])


def _segments(of: Column, alike: Column, near: Column, spread: int) -> Column:
    """Segments by which a term and its candidates meet: what it is drawn like; its halves at lengths up to ``spread`` off (pigeonhole for one edit)."""
    parts = [F.when(alike, F.concat(F.lit("="), fold_column(of)))]
    for off in range(-spread, spread + 1):
        n = F.length(of) + off
        half = F.floor(n / 2).cast("int")
        parts += [F.when(near & (n > 4), F.concat(F.lit(mark), n.cast("string"), F.lit(":"), piece)) for mark, piece in (("<", F.substring(of, F.lit(1), half)), (">", F.right(of, n - half)))]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def _of_characters(kinds: list[str]) -> Column:
    """Segments of a trigram: its two characters beside the one in question."""
    rest = {"c": F.concat(F.substring("term", 1, 1), F.substring("term", 3, 1)), "e": F.substring("term", 2, 2), "f": F.substring("term", 1, 2)}
    return F.array(*(F.concat(F.lit(k), rest[k]) for k in kinds))


def _sharded(vocabulary: DataFrame, queries: DataFrame, per_shard: int) -> DataFrame:
    """Candidates of all queries (term, segments) in the vocabulary (term, segments): ``term, candidate, distance, alike``.

    A query meets only terms that share a segment; segments are hashed to shards of about ``per_shard`` rows.
    """
    parts = max(1, -(-vocabulary.count() // (per_shard * 4)), -(-queries.count() // per_shard), vocabulary.sparkSession.sparkContext.defaultParallelism)
    v, q = (df.select("term", F.explode("segments").alias("segment")).withColumn("shard", F.pmod(F.xxhash64("segment"), F.lit(parts)).cast("int")) for df in (vocabulary, queries))
    return v.groupBy("shard").cogroup(q.groupBy("shard")).applyInPandas(candidates, "term string, candidate string, distance int, alike boolean").distinct()


def _pairs_known(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The words divided at a hyphen (kind h): ``term, whole, known, breaks``.

    The hyphen belongs to the word (``breaks`` is false) if the vocabulary has the compound, or other
    compounds with the same first part and not the word without the hyphen.
    ``whole`` is the word as it would stand in one line.
    """
    words = vocabulary.where("kind in ('w', 'p')").select("kind", F.col("term").alias("v"))
    pattern = rf"^(.*)([{HYPHENS}])([^{HYPHENS}]*)$"  # the last hyphen counts
    h = found.where("kind = 'h'").select("term", *(F.regexp_extract("term", pattern, k).alias(name) for k, name in ((1, "a"), (2, "mark"), (3, "b"))))
    parts = h.withColumns({"joined": F.concat("a", "b"), "compound": F.concat_ws("-", "a", "b"), "first": F.concat("a", F.lit("-"))})

    def has(df: DataFrame, column: str, kind: str, name: str) -> DataFrame:
        known = words.where(F.col("kind") == kind).select(F.col("v").alias(column), F.lit(True).alias(name))
        return df.join(known, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    x = has(has(has(has(parts, "joined", "w", "joined_known"), "compound", "w", "compound_known"), "first", "p", "first_known"), "b", "w", "rest_known")
    belongs = (F.col("mark") == "-") & (F.col("compound_known") & (F.col("b") != "") | F.col("first_known") & ((F.col("b") == "") | ~F.col("joined_known")))
    whole = F.when(belongs, F.when(F.col("b") != "", F.col("compound"))).otherwise(F.col("joined"))
    known = F.when(belongs, F.col("compound_known")).otherwise(F.col("joined_known"))
    return x.select("term", whole.alias("whole"), known.alias("known"), (~belongs).alias("breaks"))


def _digits_of(c: Column) -> Column:
    """Letters taken for digits, beside digits, as digits again (three passes reach three letters in a row)."""
    chars = "".join(AS_DIGIT)
    for _ in range(3):
        for a in sorted(set(AS_DIGIT.values())):
            group = re.escape("".join(k for k, v in AS_DIGIT.items() if v == a))
            c = F.regexp_replace(c, rf"(?<=\d)[{group}]|(?<![\p{{L}}])[{group}](?=[{re.escape(chars)}]{{0,2}}\d)", a)
    return c


def _more_in_scans(c: str, s: str, cc: str | Column, sc: str | Column) -> Column:
    """Whether a term (``c`` times in clean text, ``s`` in scans) is a misreading of its candidate (``cc``, ``sc``).

    A right word is as frequent beside its candidate in scans as elsewhere. A misreading is unknown to
    clean text, or got there by documents not recognised as scans: far rarer there than its candidate,
    and rarer than in scans. Both tests are ratios, so they hold at every size.
    """
    col = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0))
    c, s, cc, sc = map(col, (c, s, cc, sc))
    return (c == 0) | (cc >= RARER * c) & (s * cc >= OFTENER * (c + 1) * F.greatest(sc, F.lit(1)))


def _written_apart(parts: list[list[DataFrame]]) -> DataFrame:
    """The union of all parts without repeated rows, each list of them written by itself; missing columns are null, and no cost is 0.

    As one plan, all its joins would be planned anew whenever one of its stages ends, on the driver's memory.
    """
    fields = {"kind": "string", "term": "string", "candidate": "string", "weight": "double", "cost": "int", "breaks": "boolean"}

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()))

    return written(union([written(union(p), "pages-part") for p in parts]).fillna(0, ["cost"]).distinct(), "pages-misread")


def misread_terms(counted: DataFrame, per_shard: int = 5000) -> DataFrame:
    """The misread terms of scans: ``kind, term, candidate, weight, cost, breaks``, one row per candidate.

    ``counted``: kind, term, c (times in clean text), s (times in scans). ``cost`` is 0 for differences of
    characters drawn alike and 1 for another single character, which then also needs its context.
    """
    vocabulary = counted.where("c > 0")
    words = vocabulary.where("kind = 'w' and length(term) > 1").select("term", "c", "s")
    tri = vocabulary.where("kind = 'c'").select("term", "c", "s")
    whole_text = counted.where("kind in ('w', 'c')").groupBy("kind").agg(F.sum("c").alias("all_c"), F.sum("s").alias("all_s"))
    rate = F.broadcast(whole_text)  # two rows
    suspect = written(
        counted.where("s > 0 and kind in ('w', 'c') and length(term) > 1").join(rate, "kind")
        .where((F.col("c") == 0) | (F.col("s") * F.col("all_c") >= 2 * (F.col("c") + 1) * F.col("all_s"))).select("kind", "term", "c", "s"),
        "pages-suspect",
    )
    asked = suspect.where("kind = 'w'").select("term", "c", "s")
    digits = counted.where("kind = 'd' and s > 0").select("term").join(counted.where("kind = 'x'").select("term"), "term", "left_anti").withColumn("mask", F.regexp_replace("term", r"\d+", "0"))

    divided = written(_pairs_known(counted.where("s > 0 or kind = 'h'"), vocabulary), "pages-divided")
    joined = divided.where("whole is not null").select(F.col("whole").alias("term"), "known")
    joined = joined.where("not known").select("term").unionByName(joined.where("known").join(asked, "term", "left_semi").select("term"))
    queries = asked.select("term", (F.col("c") == 0).alias("near")).unionByName(joined.unionByName(digits.select(F.lower("term").alias("term"))).withColumn("near", F.lit(False)))
    queries = written(queries.groupBy("term").agg(F.max("near").alias("near")), "pages-queries")
    yes = F.lit(True)
    odd = suspect.where("kind = 'c'").select("term", _of_characters(["c"]).alias("segments"))
    edge = counted.where("kind in ('e', 'f')").select("term", F.when(F.col("kind") == "e", _of_characters(["e"])).otherwise(_of_characters(["f"])).alias("segments"))
    every = queries.select("term", _segments(F.col("term"), yes, F.col("near"), 1).alias("segments")).unionByName(odd).unionByName(edge)
    known = words.select("term", _segments(F.col("term"), yes, yes, 0).alias("segments")).unionByName(tri.select("term", _of_characters(["c", "e", "f"]).alias("segments")))
    close = written(_sharded(known, every, per_shard), "pages-close")

    weight = (F.log1p("cc") - 4 * F.col("distance")).alias("weight")
    as_candidate = words.select(F.col("term").alias("candidate"), F.col("c").alias("cc"), F.col("s").alias("sc"))
    near = written(close.join(as_candidate, "candidate"), "pages-near")
    inner = F.length("term") > 4
    for edge_of in (F.substring("term", 1, 1) == F.substring("candidate", 1, 1), F.right("term", F.lit(1)) == F.right("candidate", F.lit(1)), F.length("term") == F.length("candidate")):
        inner = inner & edge_of
    one_letter = (F.col("c") == 0) & inner & (F.col("distance") == 1) & (F.col("cc") >= RARER * F.col("s"))
    cost = F.when(F.col("alike"), 0).otherwise(1).alias("cost")
    by_word = asked.join(near, "term").where(F.col("alike") & _more_in_scans("c", "s", "cc", "sc") | ~F.col("alike") & one_letter).select(F.lit("w").alias("kind"), "term", "candidate", weight, cost)
    own = asked.select(F.col("term").alias("whole"), "c", "s")
    by_divided = (
        divided.join(near.where("alike").withColumnRenamed("term", "whole"), "whole").join(own, "whole", "left")
        .where(~F.col("known") | F.col("c").isNotNull() & _more_in_scans("c", "s", "cc", "sc")).select(F.lit("h").alias("kind"), "term", "candidate", weight, "breaks")
    )

    # digits with letters: judged by their masks
    masks = counted.where("kind = 'm'").select(F.col("term").alias("mask"), "c", "s")
    right = masks.select(F.col("mask").alias("right"), F.col("c").alias("cc"), F.col("s").alias("sc"))
    digits = digits.join(masks, "mask", "left").fillna(0, ["c", "s"])
    numberlike = rf"^(?:{NUMBER})(?:[.,]{NUMBER})*$"
    as_number = digits.withColumn("candidate", _digits_of(F.col("term"))).where("candidate <> term").withColumn("right", F.regexp_replace("candidate", r"\d+", "0"))
    by_digits = (
        as_number.join(right, "right", "left").fillna(0, ["cc", "sc"])
        .where(((F.col("cc") > 0) | F.col("term").rlike(numberlike)) & _more_in_scans("c", "s", "cc", "sc")).select(F.lit("d").alias("kind"), "term", "candidate", F.lit(0.0).alias("weight"))
    )
    as_word = digits.where(~F.col("term").rlike(numberlike)).select(F.col("term").alias("raw"), F.lower("term").alias("term"), "c", "s")
    by_letters = as_word.join(near.where("alike"), "term").where(_more_in_scans("c", "s", "cc", "sc")).select(F.lit("d").alias("kind"), F.col("raw").alias("term"), "candidate", weight)

    # single letters in the place of a number
    places = vocabulary.where("kind = 'n' and term like '0|_%'").select(F.substring_index("term", "|", -1).alias("after"), F.col("c").alias("cc"), F.col("s").alias("sc"))
    letters = counted.where("kind = 'n' and s > 0 and term not like '0|%'").select("term", F.substring_index("term", "|", 1).alias("raw"), F.substring_index("term", "|", -1).alias("after"), "c", "s")
    word_itself = words.select("term").join(asked.select("term"), "term", "left_anti").withColumnRenamed("term", "own")
    by_letter = (
        letters.where(F.translate("raw", "lIOSBZ", "") == "").join(places, "after").where(_more_in_scans("c", "s", "cc", "sc")).join(word_itself, F.lower("raw") == F.col("own"), "left_anti")
        .select(F.lit("n").alias("kind"), "term", F.translate("raw", "lIOSBZ", "110582").alias("candidate"), F.lit(0.0).alias("weight"))
    )

    # characters: another one fits between both neighbours, and beside each of them this one is a misreading of it
    p, c, q = (F.substring("term", k, 1) for k in (1, 2, 3))
    left = counted.where("kind = 'c'").select(F.concat(p, c).alias("pair"), "c", "s").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    after = counted.where("kind = 'c'").select(F.concat(c, q).alias("pair"), "c", "s").groupBy("pair").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    fits = close.join(tri.select(F.col("term").alias("candidate"), "c", "s").withColumnsRenamed({"c": "cc", "s": "sc"}), "candidate").where("distance = 1")

    def beside(df: DataFrame, pairs: DataFrame, first: int) -> DataFrame:
        """Keeps rows whose term is, in the pair of characters from ``first`` on, a misreading of the candidate."""
        a, b = (pairs.select(F.col("pair").alias(f"pair_{x}"), F.col("c").alias(f"c_{x}"), F.col("s").alias(f"s_{x}")) for x in "ab")
        df = df.join(a, F.substring("term", first, 2) == F.col("pair_a"), "left").join(b, F.substring("candidate", first, 2) == F.col("pair_b"), "left")
        return df.where(_more_in_scans("c_a", "s_a", "c_b", "s_b")).drop("pair_a", "pair_b", "c_a", "c_b", "s_a", "s_b")

    is_letter = lambda k: F.substring("candidate", k, 1).rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]")
    of_kind = lambda kind, k: fits.join(counted.where(F.col("kind") == kind).select("term", F.col("c").alias("own_c"), F.col("s").alias("own_s")), "term").where(is_letter(k) & (F.regexp_replace("term", "(?s)^(.{%d})." % (k - 1), "$1") == F.regexp_replace("candidate", "(?s)^(.{%d})." % (k - 1), "$1")))
    inside = beside(beside(of_kind("c", 2).where(_more_in_scans("own_c", "own_s", "cc", "sc")), left, 1), after, 2)
    first = beside(of_kind("e", 1), left.unionByName(after).groupBy("pair").agg(F.max("c").alias("c"), F.max("s").alias("s")), 1)
    last = beside(of_kind("f", 3), left.unionByName(after).groupBy("pair").agg(F.max("c").alias("c"), F.max("s").alias("s")), 2)
    by_char = [df.select(F.lit(kind).alias("kind"), "term", F.substring("candidate", k, 1).alias("candidate"), F.log1p("cc").alias("weight")) for df, kind, k in ((inside, "c", 2), (first, "e", 1), (last, "f", 3))]

    breaks = divided.where("breaks").select(F.lit("h").alias("kind"), "term", F.lit(None).cast("string").alias("candidate"), F.lit(-99.0).alias("weight"), "breaks")
    return _written_apart([[by_word], [by_divided, breaks], [by_digits, by_letters], [by_letter], by_char[:1], by_char[1:]])


def bitmap_of(misread: DataFrame) -> bytes:
    """A bitmap of the misread terms, about 16 bits a term, within :data:`BITMAP_BITS`; more terms cost false hits, which a join takes out, and lose none."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], 1 << (16 * max(1, misread.count()) - 1).bit_length()))
    at = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(bits))
    pieces = misread.select(at.alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    out = bytearray(bits // 8)
    for r in pieces.collect():  # at most 32 MB in pieces of 4 KB
        out[r.piece * 4096 : (r.piece + 1) * 4096] = r.bits
    return bytes(out)


PLACES = "tbl string, row_key string, document string, scan boolean, line int, kind string, term string, at int, raw string, before string, after string, line2 int"


def find_places(batches: Iterator[pd.DataFrame], bits) -> Iterator[pd.DataFrame]:
    """Furniture lines, and the places of terms that the bitmap has."""
    names = [x.split()[0] for x in PLACES.split(", ")]
    bitmap, known = bits.value, {}
    n_bits = len(bitmap) * 8

    def marked(term: str) -> bool:
        if (hit := known.get(term)) is None:
            if len(known) > 500_000:
                known.clear()
            at = zlib.crc32(term.encode()) % n_bits
            hit = known[term] = bool(bitmap[at >> 3] >> (at & 7) & 1)
        return hit

    for batch in batches:
        rows = []
        for tbl, key, document, scan, text, title in zip(batch["tbl"], batch["row_key"], batch["document"], batch["scan"], batch["text"], batch["title"]):
            of = (tbl, key, document, bool(scan))
            kinds = line_kinds(LINE.split(text), title)
            rows.extend((*of, i, k, "", -1, "", "", "", -1) for i, k in enumerate(kinds) if k)
            found, run = terms(text, kinds, True)
            rows.extend((*of, line, kind, term, at, raw, before, after, line2) for kind, term, line, at, raw, before, after, line2 in found if kind in "wdnh" and marked(term))
            for kind, term, x in run.trigrams():
                if marked(term):
                    line, at = run.origin(x)
                    rows.append((*of, line, kind, term, at, term[{"e": 0, "c": 1, "f": 2}[kind]], "", "", -1))
        yield pd.DataFrame(rows, columns=names)


def scan_rows(rows: DataFrame, salts: int = 16) -> DataFrame:
    """``rows`` (tbl, row_key, document, title, text) with ``scan``: whether the document is one.

    Rows of one document are spread over ``salts`` tasks; rows without a title get their document's.
    """

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            titles: dict = {}
            for d, t, title in zip(b["document"], b["text"], b["title"]):
                found[d] += shows_scan(t, title)
                titles[d] = title or titles.get(d)
            yield pd.DataFrame({"document": list(found), "signs": list(found.values()), "known_title": [titles[d] for d in found]})

    rows = rows.where("text is not null and row_key is not null").withColumn("document", F.coalesce("document", "row_key"))
    by_document = rows.select("document", "text", "title").mapInPandas(signs, "document string, signs long, known_title string").groupBy("document").agg((F.sum("signs") > 0).alias("scan"), F.max("known_title").alias("known_title"))
    spread = by_document.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return written(rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(salts)).cast("int")).join(spread, ["document", "salt"]).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "known_title")).drop("salt", "known_title"), "pages-rows")


def noisy_places(rows: DataFrame, extra_vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``scan``, all noise: tbl, row_key, line, kind, at, raw, after, line2, candidate, breaks).

    ``extra_vocabulary`` (term) adds identifiers known to be right.
    """
    spark = rows.sparkSession
    rows = scan_rows(rows)
    counts = rows.select("text", "title", "scan").mapInPandas(count_terms, "kind string, term string, c long, s long")
    if extra_vocabulary is not None:
        known = extra_vocabulary.where("term is not null").distinct()
        for kind, term in (("x", F.col("term")), ("m", F.regexp_replace("term", r"\d+", "0")), ("w", F.lower("term"))):
            counts = counts.unionByName(known.select(F.lit(kind).alias("kind"), term.alias("term"), F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("s")))
    counted = written(counts.groupBy("kind", "term").agg(F.sum("c").alias("c"), F.sum("s").alias("s")), "pages-terms")
    misread = misread_terms(counted)
    bits = spark.sparkContext.broadcast(bitmap_of(misread))
    places = rows.select("tbl", "row_key", "document", "scan", "text", "title").mapInPandas(partial(find_places, bits=bits), PLACES)
    places = written(places, "pages-places")
    pairs = counted.where("kind = 'b' and c > 0").select("term", "c")
    before, after = (pairs.withColumnsRenamed({"term": f"pair_{x}", "c": f"n_{x}"}) for x in ("before", "after"))
    ranked = (
        places.where("term <> ''").join(misread, ["kind", "term"])
        .join(before, F.when(F.col("before") != "", F.concat_ws(" ", "before", "candidate")) == F.col("pair_before"), "left")
        .join(after, F.when((F.col("cost") > 0) & (F.col("after") != ""), F.concat_ws(" ", "candidate", "after")) == F.col("pair_after"), "left")
        .where("cost = 0 or n_before > 0 and n_after > 0")
        .withColumn("score", F.col("weight") - 4 * F.col("cost") + 2 * F.log1p(F.coalesce("n_before", F.lit(0))))
        .groupBy("tbl", "row_key", "document", "scan", "line", "kind", "term", "at", "raw", "after", "line2")
        .agg(F.max_by("candidate", F.struct("score", "candidate")).alias("candidate"), F.max("breaks").alias("breaks"))
    )
    ranked = written(ranked, "pages-ranked")
    # a document with misread or divided words is a scan, too, if it shows no furniture
    also = written(ranked.where("not scan and (candidate is not null or breaks)").select("document").distinct(), "pages-also")
    noise = ranked.where("scan").unionByName(ranked.where("not scan").join(also, "document", "left_semi"))
    furniture = places.where("term = '' and scan").unionByName(places.where("term = '' and not scan").join(also, "document", "left_semi"))
    furniture = furniture.select("tbl", "row_key", "line", "kind", "at", "raw", F.lit("").alias("after"), "line2", F.lit(None).cast("string").alias("candidate"), F.lit(None).cast("boolean").alias("breaks"))
    rows = rows.join(also.withColumn("also", F.lit(True)), "document", "left").withColumn("scan", F.col("scan") | F.coalesce("also", F.lit(False))).drop("also")
    return rows, noise.select(furniture.columns).unionByName(furniture)


def noisy_lines(places: DataFrame) -> DataFrame:
    """One row per noisy line and kind: ``tbl, row_key, line_no, noise_kind``; lines count from 1."""
    half = (F.col("kind") == "h") & F.col("candidate").isNotNull()
    left_wrong = F.lower("raw") != F.expr("substring(candidate, 1, length(raw))")
    right_wrong = F.lower("after") != F.expr("right(candidate, length(after))")
    line = lambda where, no, kind: F.when(where, F.struct((F.col(no) + 1).alias("line_no"), kind.alias("noise_kind")))
    found = F.array(
        line(F.col("kind").isin("page_number", "running_header"), "line", F.col("kind")),
        line((F.col("kind") == "h") & F.col("breaks"), "line", F.lit("hyphen_break")),
        line(F.col("kind").isin("w", "d", "n", "c", "e", "f") | half & left_wrong, "line", F.lit("misread")),
        line(half & right_wrong & (F.col("line2") >= 0), "line2", F.lit("misread")),
    )
    return places.select("tbl", "row_key", F.explode(F.array_compact(found)).alias("x")).select("tbl", "row_key", "x.line_no", "x.noise_kind").distinct()


def _cased(raw: str, candidate: str) -> str:
    return candidate.upper() if raw.isupper() and len(raw) > 1 else candidate[:1].upper() + candidate[1:] if raw[:1].isupper() else candidate


def repaired_text(text: str, places: list) -> str:
    """``text`` without the noise at ``places``, its lines joined to paragraphs."""
    lines: list[str | None] = LINE.split(text)
    joins: dict[int, str] = {}
    for p in sorted(places, key=lambda p: (p["line"], -p["at"])):
        i = p["line"]
        if p["kind"] in ("page_number", "running_header"):
            lines[i] = None
        elif p["kind"] == "h":
            word = _cased(p["raw"], p["candidate"]) if p["candidate"] else p["raw"] + p["after"]
            lines[i] = lines[i][: p["at"]] + word
            joins[i] = p["after"]
        elif p["candidate"] and lines[i] is not None:
            end = p["at"] + len(p["raw"])
            new = p["candidate"] if p["kind"] in "dncef" else _cased(p["raw"], p["candidate"])
            lines[i] = lines[i][: p["at"]] + new + lines[i][end:]
    paragraphs, current, rest, before = [], "", "", ""
    wrapped = IDEOGRAPH.search(text) is not None  # lines of such scripts end after any character, within words and numbers, too
    for i, line in enumerate(lines):
        if line is None:
            continue
        s = line.strip()
        if rest and s:
            s = s[len(rest) :].lstrip() if s.startswith(rest) or len(s) >= len(rest) else s
            rest = ""
        rest = joins.get(i, rest)
        if not line.strip() or PARAGRAPH_START.match(line) or re.fullmatch(r"\d{1,5}", s) or UNIT_HEAD.search(s):
            if current:
                paragraphs.append(current)
            current = s
        elif s:
            within = wrapped and current and (IDEOGRAPH.search(s) or IDEOGRAPH.search(before)) and (current[-1].isalpha() and s[0].isalpha() or current[-1].isdigit() and s[0].isdigit() or current[-1] in "_-/" or s[0] in "_-/.,")
            tight = not current or within or current[-1] == "-" and current[-2:-1].isalnum() and s[0].isalnum() or IDEOGRAPH.match(current[-1]) or IDEOGRAPH.match(s[0]) and not current[-1].isascii() or current[-1] in "，。！？；：、（“「"
            current = current + ("" if tight else " ") + s
        before = s
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def repaired(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``tbl, row_key, text``: the text of scans as continuous paragraphs, other texts as they are; repeated rows once."""
    lists = places.groupBy("tbl", "row_key").agg(F.collect_set(F.struct("line", "kind", "at", "raw", "after", "candidate", "breaks")).alias("places"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([repaired_text(t, list(p)) for t, p in zip(text, places)])

    once = rows.select("tbl", "row_key", "text", "scan").distinct()
    none = F.array().cast(lists.schema["places"].dataType)
    joined = once.join(lists, ["tbl", "row_key"], "left")
    scans = joined.where("scan").select("tbl", "row_key", mend("text", F.coalesce("places", none)).alias("text"))
    return scans.unionByName(joined.where("not scan").select("tbl", "row_key", "text"))
