"""Sentence units of texts in any language and script.

The Unicode sentence-break properties give the end marks of all scripts, the
closing marks and the letter classes. On top of them: abbreviations by language,
quotations and brackets within a larger sentence, ordinals, numerals, initials,
ellipses, and the spaces of Thai. A text is cut at its empty lines first; the
rules then look at the marks of one paragraph only. Spark spreads the texts; a
small helper handles one text at a time and gives positions, no copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations whose stop never ends a sentence, by language.
NEVER_FINAL = {
    "en": "Dr Mr Mrs Ms Prof Rev Hon Gen Col Sgt Capt Lt St Mt Messrs vs cf approx e.g i.e viz ca al incl excl resp",
    "de": "Hr Fr Frl Dr Prof Dipl Ing ca bzw max min z.B d.h u.a i.d.R o.ä s.o s.u evtl ggf inkl exkl vgl sog St usf zzgl abzgl mind",
    "es": "Sr Sra Srta Sres Dr Dra Ing Lic Prof aprox p.ej D Dña Ud Uds máx mín",
    "fr": "Mme Mlle MM Dr Pr env c.-à-d p.ex",
    "pt": "Sr Sra Dr Dra Eng aprox p.ex",
    "it": "Sig Sigg Dott Ing Prof ca p.es",
    "ru": "т.е т.к т.н см инж прибл проф акад доц тов напр ок им ул макс мин.до",
    "hi": "डॉ क्र श्री कु प्रो कि.ग्रा कि.मी मि.मी से.मी",
    "ar": "د أ م ص ج",
}
# Abbreviations that refer to the number after them.
BEFORE_NUMBER = {
    "en": "No Nos Fig Figs Sec Secs Ch Chap Art Vol p pp Par Tab Eq Ref Rev Ver",
    "de": "Nr Nrn Abb Abschn Kap S Art Bd Tab Ziff Abs Pos",
    "es": "núm núms fig figs pág págs art cap vol sec",
    "fr": "fig no chap vol",
    "ru": "рис табл стр гл № п пп разд",
    "hi": "क्र पृ सं",
}
# Abbreviations that may also be a sentence's last word.
MAYBE_FINAL = {
    "en": "etc a.m p.m Co Ltd Inc Corp Jr Sr U.S U.K in ft oz lb hr min sec dept est",
    "de": "usw etc Std Min Sek Tel GmbH",
    "es": "etc uds ud EE.UU hs",
    "ru": "т.д т.п др г гг ч мин с руб тыс млн млрд шт",
}
# Firm endings, after which a name goes on.
FIRM = "Co Ltd Inc Corp"
# Abbreviations written in parts with spaces between.
IN_PARTS = ["z. B", "d. h", "u. a", "i. d. R", "o. ä", "s. o", "s. u", "e. g", "i. e", "a. m", "p. m", "p. ej", "p. ex", "т. е", "т. к", "т. н", "т. д", "т. п", "и т. д", "и т. п", "c. f"]
# German words before an ordinal.
BEFORE_ORDINAL = "am vom zum zur der die das dem den des im jeder jede jedes beim ab seit bis diesem dieser"
# What a sentence goes on with after a quotation that ends with an end mark.
GOES_ON = {
    "zh": r"(?:随后|然后|接着|便|就|却|的|等字|字样|时|之)",
    "zh_first": r"(?:这|那)|[^，。！？；：,.!?;:\n]{0,12}(?:问道|说道|喊道|答道|叫道|笑道|问|说|喊|叫|回答|写道|提醒|吩咐|表示)[^，。！？；：,.!?;:\n]{0,4}[，。！？：,.!?]",
    "ja": r"(?:と|って|という|の|は|が|を|に|も|で|へ|だ|な|など)",
    "ko": r"(?:라고|이라고|하고|고\s|며|라며)",
    "hi": r"(?:कहकर|कहते|कहा|पूछा|पूछकर|बोल|लिखा|ऐसा|यह कह)",
    "ar": r"(?:ثم|فقال|وقال|قال|صاح|سأل|وهو|وهي)(?!\w)",
    "th": r"(?:กล่าว|พูด|ถาม|แล้ว)",
}
# Words before a Chinese quotation that leave the sentence open after it.
LEFT_OPEN = "把将被对在用以与和跟从向给比按"

# Frequent words that tell a language in Latin letters.
FREQUENT = {
    "en": "the is are of and to in it for with then that this was were by from on at be not no if as an or must he she who when which its has have before after every keep",
    "de": "der die das und ist wird wurde werden mit für nicht zur zum den dem des ein eine einen auf bei wie oder um im am sich vor nach kann muss darf sein sowie wer als aus von es sie auch alle kam hat",
    "es": "el la los las de que para cada en es un una con por se del al y como más no su lo está fue antes después cuando ha",
    "fr": "le les des et est pour chaque une du au avec sur dans qui que pas ne il elle sont avant après",
    "pt": "o os para cada uma um do da dos das com em por que não é ao foi antes depois",
    "it": "il lo gli per ogni una di che con del della è un sono non prima dopo dal",
}


def _by_word(table: dict[str, str]) -> dict[str, frozenset[str]]:
    """The languages of each abbreviation, also as written at the beginning of a sentence."""
    out: dict[str, set] = {}
    for lang, words in table.items():
        for w in words.split():
            for x in (w, w[:1].upper() + w[1:]):
                out.setdefault(x, set()).add(lang)
    return {w: frozenset(langs) for w, langs in out.items()}


NEVER, NUMBERED, MAYBE, FREQUENT_IN, FIRMS = _by_word(NEVER_FINAL), _by_word(BEFORE_NUMBER), _by_word(MAYBE_FINAL), _by_word(FREQUENT), set(FIRM.split())
PART_WORDS = {w for p in IN_PARTS for w in p.split(". ")}
ORDINAL = regex.compile(rf"(?i)(?:^|\W)(?:{'|'.join(BEFORE_ORDINAL.split())})\s+\d{{1,2}}\Z")

CLOSE = r"""[\p{SB=CL}"'”’»“]"""
MARKS = regex.compile(rf"[\p{{SB=ST}}\p{{SB=AT}}…‥]+(?:[\p{{SB=ST}}\p{{SB=AT}}…‥]|(?<=[!?！？])\s(?=[!?！？]))*(?P<close>[\p{{Pe}}\p{{Pf}}\p{{Pi}}\"'“]*)(?P<gap>\s*)")
PARAGRAPH = regex.compile(r"(?:\r?\n|\r)[^\S\r\n]*(?:\r?\n|\r)|[  \f\v]")
QUOTES = regex.compile(r"[“”„«»「」『』（）()\[\]【】《》〈〉\"]")
PAIR = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "（": "）)", "(": ")）", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"'}
WORD = regex.compile(r"[\p{L}\p{M}\p{N}·№'’.\-]+\Z")
LIST_MARK = regex.compile(r"\s*(?:[-–•*·]\s*)?(?:[(（]?(?:\d{1,3}|\p{L}|[ivxIVX]{1,5})[.)）．])?\s*\Z")
PARTS = regex.compile("|".join(rf"(?<!\w){r'\.\s?'.join(map(regex.escape, p.split('. ')))}\." for p in sorted(IN_PARTS, key=len, reverse=True)))
STRONG = regex.compile(r"\p{SB=ST}")
SIMPLE = frozenset("。！？!?।")
SPACE = regex.compile(r"[\s\x1c-\x1f]*")
HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〇]")
WRAPPED = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[^\S\r\n]*\r?\n\s*(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
UNCASED = regex.compile(r"\p{Lo}")
LETTERS = regex.compile(r"\p{L}+")
HANGUL, HANGUL_OR_THAI, ARABIC, ANY_THAI = regex.compile(r"\p{Hangul}"), regex.compile(r"\p{Hangul}|\p{Thai}"), regex.compile(r"\p{Arabic}"), regex.compile(r"[฀-๏]")
ON = {k: regex.compile(v) for k, v in GOES_ON.items()}
SCRIPT_SEAM = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])(?=[\p{Latin}\p{N}])")
MEASURE, REFERRED, FIRM_GOES_ON = regex.compile(r"\d+\s\p{L}"), regex.compile(r"[IVX]+\b|\p{Lu}\b(?!\.?\s\p{Ll})"), regex.compile(rf"(?:{'|'.join(FIRM.split())}|KG)\b")
AFTER_FIGURE, BLANK, NOT_THAI = regex.compile(r"\d\s?\Z"), regex.compile(r"\s*\Z"), regex.compile(r"[^฀-๏]*")
CLOSING = regex.compile(CLOSE)
OPENING = regex.compile(r"[\p{Ps}\p{Pi}„\"'¿¡«]")
ODD_LOWER = regex.compile(r"(?:\p{Ll}+\p{Lu}|\p{Ll}{1,3}-\p{L}|\p{Ll}{1,2}\d)")
CAPITAL = regex.compile(r"\p{Lu}\p{Ll}|\p{Lu}\s|\p{Lu}{2,}[-_ ]?\d|[\p{Ps}\p{Pi}¿¡«„\"]")
THAI_GAP = regex.compile(r"(?<=[฀-๏])(?<![ๆ๐-๙])[^\S\r\n]+(?=[\p{L}\p{Ps}\p{Pi}\"])(?!ๆ)")


def _languages(t: str, start: int, a: int) -> frozenset[str]:
    """The languages in Latin letters that the frequent words of the sentence from ``start`` to ``a``, and of what follows it, tell; all where nothing tells one."""
    counts: dict[str, int] = {}
    for w in LETTERS.findall(t, max(start, a - 160), a + 50):
        for lang in FREQUENT_IN.get(w.lower(), ()):
            counts[lang] = counts.get(lang, 0) + 1
    most = max(counts.values(), default=0)
    return frozenset(k for k in FREQUENT if counts.get(k, 0) == most)


def _abbreviates(table: dict[str, frozenset[str]], word: str, t: str, start: int, a: int, goes_on: bool) -> bool:
    """Whether ``word`` before the stop at ``a`` is an abbreviation of the text's language; another language's counts where the text ``goes_on`` in small letters or figures."""
    langs = table.get(word)
    return langs is not None and (goes_on or langs.isdisjoint(FREQUENT) or not langs.isdisjoint(_languages(t, start, a)))


def _quotations(t: str) -> list[tuple[int, int]]:
    """Outermost (opening, closing) positions of quotations and brackets that are closed in ``t``."""
    stack: list[tuple[int, str]] = []
    found: list[tuple[int, int]] = []
    for m in QUOTES.finditer(t):
        c, i = m.group(), m.start()
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIR[stack[k][1]]), None)
        if at is not None and (c != "“" or stack[-1][1] == "„"):
            found.append((stack[at][0], i))
            del stack[at:]
        elif c in PAIR:
            stack.append((i, c))
    found.sort()
    outer: list[tuple[int, int]] = []
    for o, c in found:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    return outer


def _goes_on(t: str, o: int, e: int, first: bool) -> bool:
    """Whether the sentence of the quotation or bracket that opens at ``o`` goes on at ``e``, after its closing marks."""
    rest = t[e : SPACE.match(t, e).end() + 60]
    s = WRAPPED.sub("", rest).lstrip()
    if not s:
        return False
    n, spaced = s[0], len(s) < len(rest)
    if n in ",;:，、；：—–" or n == "-" and s[1:2].isspace() or MARKS.match(s) and not n == "…":
        return True
    if n.islower():
        return not ODD_LOWER.match(s)
    if not UNCASED.match(n):
        return False
    quoted = t[o] not in "(（[【"
    if "\u3040" <= n <= "\u30ff":
        return ON["ja"].match(s) is not None
    if HANGUL.match(n):
        return not spaced or ON["ko"].match(s) is not None
    if HAN.match(n):
        if ON["zh"].match(s) or not first and t[:o].rstrip()[-1:] in LEFT_OPEN:
            return True
        return first and quoted and ON["zh_first"].match(s) is not None
    return any(ON[k].match(s) for k in ("hi", "ar", "th"))


def _breaks(t: str, a: int, b: int, e: int, start: int) -> bool:
    """Whether the marks ``t[a:b]``, with closing marks up to ``e``, end the sentence that began at ``start``."""
    marks, rest = t[a:b], t[e : (SPACE.match(t, e).end() if t[e : e + 1].isspace() else e) + 40]
    s = rest.lstrip()
    if not s:
        return True
    n, gap, p = s[0], len(s) < len(rest), t[a - 1 : a]
    if n in ",;，、；" or n in ":：" and not gap:
        return False
    if marks in SIMPLE or STRONG.search(marks):
        return marks[-1] not in "!?" or gap or not (n.islower() or n.isdigit()) or ODD_LOWER.match(s) is not None
    if "…" in marks or "‥" in marks or len(marks) > 1:
        return gap and n.isupper()
    if marks in "．｡":
        return not ((p.isdigit() or p.isascii()) and rest[0].isdigit())
    if e > b and not (p.isalnum() and gap):  # a stop within closing marks
        return gap or n.isupper() or UNCASED.match(n) is not None
    w = WORD.search(t, max(start, a - 40), a)
    word = (w.group() if w.group().isascii() else SCRIPT_SEAM.split(w.group())[-1]).lstrip(".'’-") if w else ""
    if HAN.match(p):
        return True
    if not gap:
        if n.isdigit() and len(word) > 3 and word.isalpha() and word.islower() and MEASURE.match(s):
            return word not in NEVER and word not in NUMBERED
        if n.isdigit() or any(_abbreviates(x, word, t, start, a, False) for x in (NEVER, MAYBE, NUMBERED)) or word.split(".")[-1] in FIRMS:
            return False
        if HANGUL_OR_THAI.match(p):
            return UNCASED.match(n) is not None or CAPITAL.match(s) is not None
        if ARABIC.match(p):
            return len(word) > 1 and UNCASED.match(n) is not None
        if UNCASED.match(p):
            return False
        if p.isdigit():
            lead = t[max(start, a - 40) : a - len(word)].rstrip()
            return bool(lead) and lead[-1].isalpha() and not HAN.match(lead[-1]) and (CAPITAL.match(s) is not None or HAN.match(n) is not None)
        ends_word = p.islower() and (len(word) > 1) or p in ")）]%°℃”"
        return ends_word and (CAPITAL.match(s) is not None or ODD_LOWER.match(s) is not None or UNCASED.match(n) is not None)
    if (a - start < 12 or t[start].isspace() or t[start] in "-–•*·") and LIST_MARK.match(t[start : a + 1]) and t[start : a + 1].strip():
        return False
    tail = ""
    if word.split(".")[-1] in PART_WORDS:
        ahead = PARTS.match(t, a - len(word.split(".")[-1]))
        if ahead and ahead.end() > a + 1:
            return False
        tail = next((m.group()[:-1] for m in PARTS.finditer(t, max(start, a - 16), a + 1) if m.end() == a + 1), "")
    short = "".join(tail.split()) or word
    if _abbreviates(NEVER, short, t, start, a, not (n.isupper() or OPENING.match(n))):
        return False
    begins = n.isupper() or UNCASED.match(n) is not None or OPENING.match(n) is not None or n == "№"
    if short in NUMBERED and (n.isdigit() or n in "№#" or REFERRED.match(s)):
        return False
    if len(word) == 1 and AFTER_FIGURE.search(t[max(start, a - 4) : a - 1]) and word.isascii():  # the unit of a number
        return not n.islower() or ODD_LOWER.match(s) is not None
    if _abbreviates(MAYBE, short, t, start, a, False):
        firm = short in FIRMS
        return begins and not (firm and (UNCASED.match(n) or FIRM_GOES_ON.match(s))) or ODD_LOWER.match(s) is not None
    last = word.split(".")[-1]
    if len(last) == 1 and last.isalpha() and not (len(word) > 1 and word[-2:-1] in "·"):
        return not last.isupper() and begins and not UNCASED.match(last)
    if last.isdigit() and ORDINAL.search(t[max(start, a - 24) : a]) and n.isupper():
        return False
    if n.islower():
        return ODD_LOWER.match(s) is not None
    return n not in "-–—"


def _paragraph(t: str) -> list[tuple[int, int]]:
    """Sentence spans of one paragraph."""
    cuts, start = [0], 0
    quotes, k = _quotations(t), 0
    for m in MARKS.finditer(t):
        a, end = m.span()
        if end == a + 1 and t[a] == "." and t[a - 1 : a].isdigit() and t[end : end + 1].isdigit():  # within a number
            continue
        b, e = m.start(1), m.start(2)
        while k < len(quotes) and quotes[k][1] < a:
            k += 1
        within = k < len(quotes) and quotes[k][0] < a
        if not within and e > b and k < len(quotes) and quotes[k][0] < e:  # what follows the marks opens a new quotation
            e = max(b, quotes[k][0])
        elif not within:
            while e > b and t[e - 1] == '"':
                e -= 1
        if within:
            o, c = quotes[k]
            closed = b <= c < e
            first = not LIST_MARK.sub("", t[start:o]).strip()
            after = c + 1
            while after < len(t) and CLOSING.match(t[after]) and not (k + 1 < len(quotes) and quotes[k + 1][0] == after):
                after += 1
            ends = MARKS.match(t[c - 1]) is not None or BLANK.match(t[o + 1 : c]) is not None
            j = c - 1
            while j > o and CLOSING.match(t[j]):
                j -= 1
            ends = MARKS.match(t[j]) is not None
            on = _goes_on(t, o, after, first)
            if closed:
                if on or not ends:
                    continue
                e = after
                ok = not (not first and t[o] in "(（[【" and not STRONG.search(t[a:b]) and t[e : e + 1] in ".。")
            else:
                if not first or on or not ends:
                    continue
                ok = _breaks(t, a, b, e, start)
        else:
            ok = _breaks(t, a, b, e, start)
        if ok and e > start:
            cuts.append(e)
            start = e
    cuts.append(len(t))
    return [(x, y) for x, y in zip(cuts, cuts[1:]) if t[x:y].strip()]


def _thai(t: str, x: int, y: int) -> list[tuple[int, int]]:
    """Splits a span with Thai letters at the spaces between sentences."""
    cuts = [x]
    for m in THAI_GAP.finditer(t, x, y):
        n = t[m.end()]
        if "\u0e00" <= n <= "\u0e4f":
            cuts.append(m.start())
        else:  # another script sets off a name, unless it fills the rest of the span as a sentence
            other = NOT_THAI.match(t, m.end(), y).group()
            if m.end() + len(other) == y and (len(other.split()) > 3 or HAN.match(n) and len(other) > 3):
                cuts.append(m.start())
    cuts.append(y)
    return list(zip(cuts, cuts[1:]))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentence spans of ``text`` as (first, last) character positions from 1, without outer white space."""
    out: list[tuple[int, int]] = []
    at = 0
    edges = [(m.start(), m.end()) for m in PARAGRAPH.finditer(text, overlapped=False)] + [(len(text), len(text))]
    for end, after in edges:
        t = text[at:end]
        if t and not t.isspace():
            spans = _paragraph(t)
            if ANY_THAI.search(t):
                spans = [z for x, y in spans for z in _thai(t, x, y)]
            for x, y in spans:
                s = t[x:y]
                left = len(s) - len(s.lstrip())
                if left < len(s):
                    out.append((at + x + left + 1, at + x + len(s.rstrip())))
        at = after
    return out


def sentences(documents: DataFrame, *, key: str, text: str) -> DataFrame:
    """Sentences of every text in order: ``<key>, sent_no, start_char, end_char``.

    Positions count code points from 1. Null and blank texts give no rows, an
    empty table none; repeated rows count once; other columns are ignored. One
    shuffle spreads the texts and takes out the repeats, one pass over Arrow
    batches gives the rows.
    """
    rows = documents.select(F.col(key).alias("row_key"), F.col(text).alias("t")).where("t is not null").dropDuplicates()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, number, first, last = [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                for k, (x, y) in enumerate(sentence_spans(t), 1):
                    of.append(i)
                    number.append(k)
                    first.append(x)
                    last.append(y)
            ints = [pa.array(x, pa.int32()) for x in (number, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(pa.array(of, pa.int64())), *ints], names=[key, "sent_no", "start_char", "end_char"])

    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), *(T.StructField(c, T.IntegerType()) for c in ("sent_no", "start_char", "end_char"))])
    return rows.mapInArrow(cut, schema)
