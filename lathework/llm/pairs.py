"""Broken prompt and response pairs, found by noisy labelling functions and a label model.

Every labelling function looks at a pair and votes for a defect, against it, or
abstains; all are column expressions. For each defect the vote patterns are
counted over all pairs, and expectation maximization over the counted patterns
estimates how far each function can be trusted. The number of patterns depends
on the functions only, not on the data. Each pair then gets the posterior of its
pattern, and keeps every defect whose posterior exceeds the defect's cutoff.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.session import written

DEFECTS = ["empty", "copies_question", "refusal", "other_language", "truncated"]

UNSEEN = r"[\p{Z}\p{Cc}\p{Cf}\u034F\u115F\u1160\u3164\uFFA0\u2800]"
NO_LETTERS = r"[^\p{L}\p{N}]"

# Stand-ins for a missing answer, letters and digits only, in lower case.
STAND_INS = (
    "na none null nil nan tbd tba todo tbc unknown undefined empty blank missing pending noanswer noresponse br nbsp nodata notavailable"
    " 无 暂无 空 空白 未知 未填 未填写 待定 待补充 待完善 待确认 略 没有 无数据 暂缺 缺失 答 回答 答案 如题 同上"
    " なし 無し 未定 未記入 不明 該当なし 空欄 答え ka keineangabe keine leer offen fehlt antwort answer response a ans"
    " нет пусто ответ nohay ninguna ninguno vacío respuesta 없음 미정 답 답변 無 لاشيء अज्ञात ไม่มี"
).split()
# Refusals, by language.
REFUSALS = {
    "zh": r"(?:无法|不能|没办法|没法|难以|无从|不便|不可以)(?:为您|给您|帮您|帮你|向您|对此)?(?:提供|回答|解答|给出|确认|答复|作答|帮助|解决您|告知|查到|找到)|(?:没有|未能|未|没)(?:找到|查到|检索到|收录)|查不到|超出.{0,10}(?:范围|能力)|不在.{0,8}范围|(?:不知道|不清楚|不了解)(?:答案|这|该|如何|怎么)?|(?:知识库|资料|文档|手册)(?:中|里)?(?:没有|未|并无)",
    "en": r"(?i)\b(?:cannot|can't|can not|could not|couldn't|unable to|not able to|won't|will not)\s+(?:\w+\s+){0,2}?(?:answer|help|provide|find|assist|discuss|give|tell|comment)\b|\b(?:do|does|did) not (?:contain|include|cover|know|have)\b|\bdon't (?:know|have)\b|\bno (?:information|answer|data|relevant|matching)\b|\b(?:outside|beyond) (?:of )?(?:what|my|the|our)\b|\bnot (?:covered|found|available|known)\b",
    "ja": r"情報が(?:ありません|ない|見つかりません)|(?:お答え|回答|ご案内|対応|お伝え)(?:すること)?(?:が|は)?(?:でき|いたしかね|しかね)|分かりません|わかりません|見つかりません|存じません",
    "de": r"(?i)\b(?:kann|können|konnte|darf)\b.{0,40}\b(?:nicht|keine?n?)\b.{0,30}\b(?:beantworten|antworten|geben|sagen|helfen|finden|nennen)|\bkeine (?:information|angabe|auskunft|antwort)|\b(?:nicht|keine)\b.{0,30}\b(?:bekannt|gefunden|enthalten|vorhanden)\b|\bweiß\b.{0,12}\bnicht\b|\benthalten\b.{0,40}\bkeine\b",
    "es": r"(?i)\bno (?:puedo|podemos|se puede|es posible) (?:\w+ ){0,2}?(?:responder|ayudar|dar|proporcionar|contestar|facilitar|encontrar)|\bno (?:hay|tengo|tenemos|existe|contiene\w*|figura\w*|aparece\w*|encuentro|encontr\w+|dispongo)\b|\bno lo sé\b|\bfuera de\b",
    "ru": r"(?i)не (?:могу|можем|удалось|смогу)\s+(?:\S+\s+){0,2}?(?:ответить|помочь|найти|предоставить|дать|сообщить)|нет (?:такой |этой |нужной )?(?:информации|данных|сведений|ответа)|не (?:найден\w*|содержит\w*|знаю|известно)",
    "ko": r"(?:정보|자료|내용|답변)(?:가|이|는|은|를|을)?\s*(?:없|찾을 수 없|드릴 수 없)|(?:답변|대답|도움|제공|안내)\S*\s*(?:할 수 없|드릴 수 없|어렵)|알 수 없|모르겠",
    "ar": r"لا (?:أستطيع|يمكنني|أعرف|توجد|يوجد|تتوفر)|لم (?:أجد|يتم العثور)",
    "hi": r"(?:जानकारी|उत्तर)\s*(?:उपलब्ध )?नहीं|नहीं (?:दे|बता) सकत|पता नहीं",
    "th": r"ไม่(?:สามารถ|มีข้อมูล|พบข้อมูล|ทราบ)",
    "fr": r"(?i)\bne (?:peux|pouvons|sais|contien\w+) pas\b|\baucune information\b",
    "pt": r"(?i)\bnão (?:posso|sei|há|tenho|contém|foi possível)\b",
}
#: Scripts without which the refusals of a language cannot occur.
SCRIPT_OF = {"zh": r"\p{IsHan}", "ja": r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]", "ru": r"\p{IsCyrillic}", "ko": r"\p{IsHangul}", "ar": r"\p{IsArabic}", "hi": r"\p{IsDevanagari}", "th": r"\p{IsThai}"}
# Apologies and advice that go with a refusal.
APOLOGIES = r"(?i)抱歉|对不起|遗憾|sorry|unfortunately|apolog|恐れ入りますが|申し訳|残念|leider|bedau|lo siento|lamento|к сожалению|извините|죄송|유감|عذر|للأسف|क्षमा|खेद|ขออภัย|désolé|malheureusement|desculp|infelizmente"
ADVICE = r"(?i)(?:请|建议您?)(?:联系|咨询|换个|询问|参考其他)|contact the|ask (?:the|your)|consult|rephrase|wenden sie sich|consulte|póngase|обратитесь|문의|お問い合わせ|ご相談|अपने|اتصل"
# Words of a question put in front of its repetition.
FRAMES = r"(?i)问题|提问|问|您|你|的|是|关于|我|想|请|question|you|your|asked|ask|the|is|was|about|re|q|frage|ihre|lautet|die|sie|fragen|zu|ご質問|質問|は|です|について|pregunta|su|la|es|вопрос|ваш|질문|은|는|입니다|السؤال|प्रश्न|คำถาม"
# Questions about a translation or the meaning of a foreign wording.
ON_WORDING = r"(?i)翻译|译成|英文|英语|日文|日语|德文|德语|中文怎么|外文|是什么意思|什么含义|怎么说|translat|what does .* mean|meaning of|in (?:english|german|chinese|japanese|spanish|russian|french)\b|auf (?:englisch|deutsch|chinesisch|japanisch|spanisch)|übersetz|bedeutet|heißt .* auf|英訳|和訳|翻訳|英語で|日本語で|中国語で|どういう意味|意味は|en inglés|en alemán|en español|traduc|significa|по-английски|по-русски|по-немецки|перев[её]д|что означает|как будет|영어로|번역|무슨 뜻|ترجم|بالإنجليزية|अनुवाद|अंग्रेज़ी|แปล|ภาษาอังกฤษ"
# Frequent short words of languages in Latin letters.
STOPWORDS = {
    "en": "the is are of to and every for with on then at from it if an by be this that what which how when as cannot not no check has does",
    "de": "der die das und ist wird werden alle mit für nicht zur zum den dem des an ein eine einen auf laut bei wie oft welche welcher wer was dann danach zuerst kann sie ihre trägt prüfen neue neues",
    "es": "el la los las de que para cada lleva sirve es en un una con por se del al pare cómo qué cuál cuándo hace tiene",
    "fr": "le les des et est pour chaque une du au avec sur dans qui que quel quelle comment toutes",
    "pt": "os as para cada uma um do da dos das com em por qual como não",
    "it": "il lo gli per ogni una di che con del della come quale nel",
}
# Last words that leave a sentence open.
OPEN_WORDS = (
    "the a an of to and or with for by in on at from then because if when that which is are be must should its this see via per than as into"
    " der die das den dem des und oder mit für von zu zum zur ein eine einen auf bei wird werden ist sind dass weil wenn sowie im am"
    " el la los las de y o con para por en un una que se del al es son и или в на с для по из что от к при"
).split()
OPEN_ENDS = r"(?:另外还应当|还应当|还应|以及|并且|并|或者|或|和|与|包括|如下|其中|然后|接着|因为|由于|如果|例如|比如|及|的|将|把|对|在|从|即|为|是|そして|また|および|ならびに|または|を|が|に|で|と|の|は)$"
END_MARK = r"[.!?。！？।؟．｡]\s*[\"'”’」』）)»】\]]*$"
LIST_BEGUN = r"(?:\n|[:：])[^\S\n]*[(（]?\d{1,2}[.、．)）]"
INNER_END = r"[。！？।؟]\s*[^\s\"'”’」』）)»]|[.!?]\s+\p{L}"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
_PART = rf"[\p{{L}}\p{{N}}\p{{M}}_/²³①-⑳½™°№#.,·\-&&[^{_CJK}]]"
#: Tokens with a digit outside scripts without spaces, that is identifiers and values.
CODED = rf"{_PART}{{0,60}}\d(?:{_PART}{{0,60}}[\p{{L}}\p{{N}}²³™°&&[^{_CJK}]])?"

#: Characters by which stems and complete answers meet first.
ANCHOR = 6

#: How a function behaves at the outset, before the model is fitted: P(for | defect), P(for | none), P(against | defect), P(against | none).
SURE_FOR, LIKELY_FOR, HINT_FOR = (0.8, 0.002, 0.02, 0.5), (0.6, 0.01, 0.03, 0.4), (0.4, 0.05, 0.1, 0.3)
SURE_AGAINST = (0.001, 0.001, 0.02, 0.5)


def seen(c: Column) -> Column:
    """``c`` without characters of which nothing can be seen at its ends; null is ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{UNSEEN}+|{UNSEEN}+$", "")


def letters_only(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NO_LETTERS, ""))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def with_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the language of the sentence in ``text`` by script and frequent words; null where nothing tells it.

    Quoted text, identifiers, values and words in capitals do not count.
    """
    quoted = r"[“\"«「『„《][^“”\"«»「」『』„《》]*[”\"»」』“》]"
    short_coded = rf"[\p{{L}}\p{{M}}]{{1,4}}-\d+|{CODED}|(?<!\p{{L}})\p{{Lu}}[\p{{Lu}}\p{{M}}]+(?!\p{{L}})|(?<!\p{{L}})(?:MPa|mm|rpm|kg|min|bar)(?!\p{{L}})"
    df = df.withColumn("_t", F.lower(F.regexp_replace(F.regexp_replace(text, quoted, " "), short_coded, " ")))
    scripts = [("ja", r"[\p{IsHiragana}\p{IsKatakana}]", 2), ("ko", r"\p{IsHangul}", 2), ("zh", r"\p{IsHan}", 4), ("ru", r"\p{IsCyrillic}", 6), ("ar", r"\p{IsArabic}", 4), ("hi", r"\p{IsDevanagari}", 3), ("th", r"\p{IsThai}", 4)]
    counts = {f"_s_{k}": count_of(F.col("_t"), pattern) for k, pattern, _ in scripts}
    counts = {k: F.when(F.col("_t").rlike(r"[^\x00-\x7f]"), c).otherwise(0) for k, c in counts.items()}
    in_list = lambda v: F.size(F.filter("_words", lambda w: w.isin(v.split())))
    counts |= {f"_w_{k}": in_list(v) for k, v in STOPWORDS.items()}
    counts["_w"] = F.size(F.filter("_words", lambda w: w.rlike(r"^[\p{IsLatin}\p{M}]{3}")))
    df = df.withColumn("_words", F.split("_t", r"[^\p{L}\p{M}]+")).withColumns(counts)
    best = F.greatest(*(F.col(f"_w_{k}") for k in STOPWORDS))
    lang = None
    for k, _, least in scripts:
        hit = F.col(f"_s_{k}") >= least
        lang = F.when(hit, k) if lang is None else lang.when(hit, k)
    for k in STOPWORDS:
        lang = lang.when((best > (0 if k in ("en", "de") else 1)) & (F.col(f"_w_{k}") == best), k)
    return df.withColumn(out, lang.when(F.col("_w") >= 3, "latin")).drop("_t", "_words", *counts)


def masked(c: Column) -> Column:
    """``c`` with identifiers and values as 0 and single spaces."""
    return F.regexp_replace(F.regexp_replace(c, CODED, "0"), r"\s+", " ")


def vote(for_: Column, against: Column | None = None) -> Column:
    """1, -1 or 0; null conditions count as false."""
    v = F.when(F.coalesce(for_, F.lit(False)), 1)
    return (v.when(F.coalesce(against, F.lit(False)), -1) if against is not None else v).otherwise(0)


def planted(pairs: DataFrame, sample: int | None = None, *, bucket: int = 20_000) -> DataFrame:
    """A labelled set made from all pairs: ``row_key`` (null), ``question, answer, planted``.

    Of the pairs with a complete answer (with ``sample`` so many, those with the smallest hashes), without those that repeat their question, sound like a
    refusal or differ in language, each comes as it is ('none') and once with every defect: nothing or a stand-in, cut off after six tenths, a refusal, the question itself, and an answer of a pair in another script.
    """
    whole = F.col("answer").rlike(END_MARK) & (F.length("answer") >= 20) & (F.length("question") >= 4)
    some = pairs.where(whole).select("question", "answer").distinct()
    if sample is not None:
        some = some.orderBy(F.xxhash64("question", "answer"), "question", "answer").limit(sample)
    some = with_language(with_language(some, "question", "q_lang"), "answer", "a_lang")
    sound = ~F.contains(letters_only(F.col("answer")), letters_only(F.col("question"))) & F.coalesce(F.col("q_lang") == F.col("a_lang"), F.lit(False))
    for pattern in REFUSALS.values():
        sound = sound & ~F.col("answer").rlike(pattern)
    some = written(some.where(sound).select("question", "answer").withColumns({"h": F.xxhash64("question", "answer"), "han": F.col("question").rlike(r"\p{IsHan}")}), "pairs-sound")
    some = some.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(max(1, some.count() // bucket))))  # about ``bucket`` rows are ranked at once
    rank = F.row_number().over(Window.partitionBy("han", "b").orderBy("h", "question"))
    ranked = some.withColumn("r", rank)
    other = ranked.select((~F.col("han")).alias("han"), "b", "r", F.col("answer").alias("foreign")).where(~F.col("han").eqNullSafe(F.col("foreign").rlike(r"\p{IsHan}")))
    x = ranked.join(other, ["han", "b", "r"], "left")
    refusal = F.when(F.col("han"), "很抱歉，无法回答该问题。").otherwise("Sorry, I cannot answer this question.")
    blank = F.element_at(F.array(F.lit(""), F.lit("N/A"), F.lit("……")), (F.pmod("h", F.lit(3)) + 1).cast("int"))
    made = {"none": F.col("answer"), "empty": blank, "truncated": F.left("answer", F.floor(F.length("answer") * 0.6).cast("int")), "refusal": refusal, "copies_question": F.col("question"), "other_language": F.col("foreign")}
    each = x.select("question", F.explode(F.array(*(F.struct(F.lit(d).alias("planted"), a.alias("answer")) for d, a in made.items()))).alias("m"))
    return each.where("m.answer is not null").select(F.lit(None).cast(pairs.schema["row_key"].dataType).alias("row_key"), "question", "m.answer", "m.planted")


def prepared(pairs: DataFrame) -> DataFrame:
    """Features of the pairs (question, answer): normal forms, languages, and whether a text begins a longer complete answer.

    Rows with ``planted`` get the features, but count for none of the figures on how texts go on.
    """
    p = pairs.withColumns({"q": seen(F.col("question")), "a": seen(F.col("answer"))})
    p = p.withColumns({"qk": letters_only(F.col("q")), "ak": letters_only(F.col("a"))})
    p = with_language(with_language(p, "q", "q_lang"), "a", "a_lang").withColumn("am", masked(F.col("a")))
    p = p.withColumn("ends", F.col("a").rlike(END_MARK) & ~F.col("a").rlike(rf"(?:…|\.\.|{LIST_BEGUN})\s*$"))
    refusing = F.lit(False)
    for lang, pattern in REFUSALS.items():
        script = SCRIPT_OF.get(lang)
        refusing = refusing | (F.col("a").rlike(script) & F.col("a").rlike(pattern) if script else F.col("a").rlike(pattern))
    coded = lambda c: F.regexp_extract_all(c, F.lit(f"({CODED})"), 1)
    p = p.withColumns({
        "refusing": refusing,
        "has_value": F.size(F.array_except(coded("a"), coded("q"))) > 0,
        "rest": F.when(F.col("qk") != "", F.replace("ak", "qk", F.lit("\u0001"))).otherwise(F.col("ak")),
    })
    p = written(p, "pairs-prepared")
    # open texts by their form: the words that the question has, too, do not count
    token = rf"([{_CJK}]|[^\s{_CJK}]+|\s+)"
    asked = F.lower("q")
    own = F.transform(F.regexp_extract_all("am", F.lit(token), 1), lambda t: F.when(F.contains(asked, F.lower(t)) & t.rlike(r"\p{L}"), "_").otherwise(t))
    open_ = p.where("not ends and am <> ''").select("am", "planted", F.regexp_replace(F.array_join(own, ""), r"_(?:\s*_)*", "_").alias("form"))
    texts = written(open_.groupBy("form", "am").agg(F.count_if(F.col("planted").isNull()).alias("n")).withColumn("stem", F.regexp_replace("am", r"[\s…\uFFFD.]+$", "")), "pairs-open")
    onward = continuations(p.where("ends and length(am) > 6 and planted is null").groupBy("am").agg(F.count("*").alias("n")), texts.select("stem").distinct())
    texts = texts.join(onward, "stem", "left").fillna(0, ["goes_on", "one_way"])
    by_form = texts.groupBy("form").agg(F.sum("n").alias("form_n"), F.sum("goes_on").alias("form_on"))
    measures = texts.select("form", "am", "goes_on", "one_way").join(by_form, "form").groupBy("am").agg(*(F.max(c).alias(c) for c in ("goes_on", "one_way", "form_n", "form_on")))
    measures = measures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = p.where("not ends").withColumn("salt", F.pmod(F.xxhash64("row_key", "question"), F.lit(16)).cast("int"))
    with_forms = salted.join(measures, ["am", "salt"], "left").drop("salt")
    return with_forms.unionByName(p.where("ends"), allowMissingColumns=True).fillna(0, ["goes_on", "one_way", "form_n", "form_on"])


def continuations(complete: DataFrame, stems: DataFrame) -> DataFrame:
    """How complete answers go on after a stem: ``stem, goes_on, one_way``: how many do, and how many with the commonest next character.

    ``complete``: am, n; ``stems``: stem. An answer is cut only where a stem with its first characters ends, so what is
    written grows with the answers and the stems that can match, not with the square of the length.
    """
    anchor = lambda c: F.left(c, F.lit(ANCHOR))
    lengths = stems.where(F.length("stem") > 1).groupBy(anchor(F.col("stem")).alias("anchor")).agg(F.collect_set(F.length("stem")).alias("lengths"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(2), F.lit(ANCHOR)), lambda i: F.left("am", i)))
    met = complete.withColumn("anchor", F.explode(starts)).join(lengths, "anchor")
    cut = met.select("am", "n", F.explode("lengths").alias("i")).where(F.col("i") < F.length("am"))
    ways = cut.groupBy(F.left("am", F.col("i")).alias("stem"), F.substr(F.col("am"), F.col("i") + 1, F.lit(1)).alias("next")).agg(F.sum("n").alias("n"))
    return ways.join(stems, "stem", "left_semi").groupBy("stem").agg(F.sum("n").alias("goes_on"), F.max("n").alias("one_way"))


def labelling_functions() -> dict[str, dict[str, tuple[Column, tuple]]]:
    """By defect and name: (vote, behaviour at the outset)."""
    q, a, qk, ak = F.col("q"), F.col("a"), F.col("qk"), F.col("ak")
    n = F.length(ak)
    value = a.rlike(rf"^[^\p{{L}}\p{{N}}]*(?:\p{{Lu}}\p{{L}}{{0,6}}[ -])?{CODED}(?:\s(?:\p{{Lu}}+|\p{{L}}*\d\S*))?(?:\s*(?:[\p{{IsLatin}}\p{{IsCyrillic}}%°℃·/²³]{{1,8}}|\p{{IsHan}}{{1,2}}|\p{{IsHangul}}{{1,2}}))?[^\p{{L}}\p{{N}}]*$")
    rest, refusing, has_value = F.col("rest"), F.col("refusing"), F.col("has_value")
    after = F.substring_index(rest, "\u0001", -1)
    before = F.substring_index(rest, "\u0001", 1)
    repeats = (qk != "") & (F.length(qk) >= 4) & F.contains(ak, qk)
    framing = F.regexp_replace(F.translate(rest, "\u0001", ""), FRAMES, "")
    last_word = F.lower(F.regexp_extract(a, r"(?<![\p{L}\p{M}])([\p{L}\p{M}]+)$", 1))
    opened = count_of(a, r"[(（「『“\[【《«]") > count_of(a, r"[)）」』”\]】》»]")
    both = F.col("q_lang").isNotNull() & F.col("a_lang").isNotNull()
    latin = F.array(*(F.lit(x) for x in [*STOPWORDS, "latin"]))
    script_differs = both & (F.col("q_lang") != F.col("a_lang")) & ~(F.array_contains(latin, F.col("q_lang")) & F.array_contains(latin, F.col("a_lang")))
    words_differ = both & (F.col("q_lang") != F.col("a_lang")) & F.array_contains(latin, F.col("q_lang")) & F.array_contains(latin, F.col("a_lang")) & (F.col("q_lang") != "latin") & (F.col("a_lang") != "latin")
    sentence_like = (F.size(F.split(F.trim(a), r"\s+")) >= 3) | (F.length(F.regexp_replace(a, r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]", "")) >= 5)
    on_wording = q.rlike(ON_WORDING)
    trailing = a.rlike(rf"{LIST_BEGUN}$") | a.rlike(r"[,，、;；:：(（\[【「“/–—-]$|(?:…|\.\.+)$|�$")
    begins = F.col("one_way") > 0.9 * F.col("goes_on")  # longer answers go on from here in one way: no natural end
    cjk = F.length(F.regexp_replace(a, rf"[^{_CJK}]", ""))
    open_sign = trailing | last_word.isin(OPEN_WORDS) & (n > 12) | a.rlike(OPEN_ENDS) & (n > 6) | opened
    known_form = (F.col("form_n") >= 1.5 * (F.col("form_on") + 2)) & ~begins & ~open_sign  # such texts mostly stop here; a share, with two open cases as its prior
    name = ~F.col("ends") & ~begins & ~a.rlike(r"[\p{P}\d]") & (F.size(F.split(a, r"\s+")) <= 4) & (cjk <= 8)
    clause = ~F.col("ends") & ~known_form & ((F.size(F.split(a, r"\s+")) >= 9) | (n >= 28) & a.rlike(",") | (cjk >= 10))
    return {
        "empty": {
            # forms of an empty answer exclude one another: as several functions each would speak against the others
            "blank": (vote((ak == "") | ak.isin(STAND_INS) | a.rlike(r"(?i)^(?:答|回答|答案|answer|antwort|response|a|答え|ответ|respuesta|답변?)\s*[:：]?\s*$") | a.rlike(r"^(?:<[^>]*>\s*|&\w+;\s*)+$"), n >= 12), SURE_FOR),
            "value": (vote(F.lit(False), has_value | (n >= 6)), SURE_AGAINST),
        },
        "copies_question": {
            "same": (vote((ak == qk) & (ak != ""), ~repeats), SURE_FOR),
            "only_repeats": (vote(repeats & (F.translate(rest, "\u0001", "") == ""), ~repeats | (F.length(after) > 8)), SURE_FOR),
            "framed": (vote(repeats & (framing == "") & (F.length(after) <= 6), ~repeats | (F.length(framing) > 12) | (F.length(after) > 8)), SURE_FOR),
            "ends_with_question": (vote(repeats & (F.length(after) <= 3) & (F.length(before) <= 24), ~repeats | (F.length(after) > 8)), LIKELY_FOR),
            "adds_value": (vote(F.lit(False), has_value), SURE_AGAINST),
        },
        "refusal": {
            "phrase": (vote(refusing, ak == ""), SURE_FOR),
            "apology": (vote(a.rlike(APOLOGIES) & ~has_value, has_value), HINT_FOR),
            "advice": (vote(a.rlike(ADVICE) & ~has_value), HINT_FOR),
            "content": (vote(F.lit(False), has_value | (ak == "") | ~refusing & (n >= 4)), SURE_AGAINST),
        },
        "other_language": {
            # by script or by words: they never vote together, so as two functions each would speak against the other
            "differs": (vote((script_differs | words_differ) & sentence_like & ~on_wording, both & (F.col("q_lang") == F.col("a_lang"))), SURE_FOR),
            "wording_asked": (vote(F.lit(False), on_wording | value), SURE_AGAINST),
            "no_sentence": (vote(F.lit(False), ~sentence_like | F.col("a_lang").isNull()), SURE_AGAINST),
        },
        "truncated": {
            "open_end": (vote((n > 0) & ~F.col("ends") & open_sign, F.col("ends")), SURE_FOR),
            "goes_on": (vote(((begins & (n > 1)) | (F.col("goes_on") > 0) & ~name) & ~value, F.col("ends") | known_form), SURE_FOR),
            "stops_after_sentence": (vote(~F.col("ends") & a.rlike(INNER_END) & (n > 6), F.col("ends") | known_form), LIKELY_FOR),
            "long_without_end": (vote(clause, F.col("ends") | known_form), HINT_FOR),
            "bare": (vote(F.lit(False), value | known_form | name | F.col("ends")), SURE_AGAINST),
        },
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, outset: np.ndarray, *, rate: float = 0.03, rounds: int = 60, trust: float = 20_000.0) -> tuple[np.ndarray, float, np.ndarray]:
    """Posteriors of all vote patterns by expectation maximization.

    ``patterns`` (pattern x function) holds -1, 0 and 1, ``counts`` how often each
    occurs, ``outset`` (function x 4) the behaviour at the outset, which stays in
    the estimate with the weight of ``trust`` pairs, however many there are. A defect must be
    claimed by a function at least: a pattern without a vote for it has posterior 0, which also
    keeps the classes from changing places. Gives posteriors, the share of defective pairs and
    the fitted table P(vote | class).
    """
    claimed = (patterns == 1).any(axis=1)
    total = counts.sum()
    prior = np.empty((patterns.shape[1], 2, 3))  # function, class (none, defect), vote -1 0 1
    prior[:, 1, 2], prior[:, 0, 2], prior[:, 1, 0], prior[:, 0, 0] = outset.T
    prior[:, :, 1] = 1 - prior[:, :, 0] - prior[:, :, 2]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    table, share = prior.copy(), rate
    posterior = np.zeros(len(counts))
    for _ in range(rounds):
        log = np.einsum("pfv,fcv->pc", onehot, np.log(table)) + np.log([1 - share, share])
        posterior = np.where(claimed, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500))), 0.0)
        weight = np.stack([counts * (1 - posterior), counts * posterior], axis=1)
        mass = weight.sum(axis=0)
        hard = trust * np.array([1 - rate, rate]) + 1
        table = (np.einsum("pc,pfv->fcv", weight, onehot) + hard[None, :, None] * prior) / (mass + hard)[None, :, None]
        share = min(max(float(mass[1] / total), 1e-6), 0.5)
    return posterior, share, table


def best_cutoff(posterior: np.ndarray, right: np.ndarray, wrong: np.ndarray, share: float, least: float = 0.5) -> float:
    """The cutoff, at least ``least``, with the largest F1 on a labelled set: ``right`` and ``wrong`` count its pairs with and without the defect by pattern.

    The defective ones are weighted to the ``share`` that they have in the data. Without labelled pairs it is ``least``.
    """
    if not right.sum() or not wrong.sum():
        return least
    order = np.argsort(-posterior)
    p = posterior[order]
    hits = np.cumsum(right[order]) / right.sum() * share
    false = np.cumsum(wrong[order]) / wrong.sum() * (1 - share)
    last = np.append(p[1:] != p[:-1], True)  # patterns with one posterior stand and fall together
    f1 = np.where(last & (p >= least), 2 * hits / (hits + false + share), -1.0)
    best = len(f1) - 1 - int(f1[::-1].argmax())  # the lowest of equally good ones: patterns that the labelled set lacks count by their posterior
    return float(p[best]) - 1e-9 if f1[best] > 0 else least


def labelled(pairs: DataFrame, *, sample: int | None = None) -> DataFrame:
    """``row_key``, the pair and ``labels``: array<struct<defect, posterior>> of all defects above their cutoffs, most probable first.

    ``pairs`` has row_key, question, answer; repeated rows of one row_key and text count
    once, null texts as ''. The cutoffs are validated on a labelled set made from all pairs, with ``sample`` from so many (:func:`planted`). An empty table gives no rows.
    """
    spark = pairs.sparkSession
    real = pairs.select("row_key", "question", "answer").distinct()
    p = prepared(real.withColumn("planted", F.lit(None).cast("string")).unionByName(planted(real, sample)))
    functions = labelling_functions()
    voted = written(p.select("row_key", "question", "answer", "planted", *(F.array(*(v for v, _ in fs.values())).alias(f"v_{d}") for d, fs in functions.items())), "pairs-votes")
    out = voted.where("planted is null").drop("planted")
    kept = []
    for d, fs in functions.items():
        n = F.count_if(F.col("planted").isNull())  # of several defects the first in the order counts, so those before d may well carry its label
        seen_patterns = voted.groupBy(f"v_{d}").agg(n.alias("n"), F.count_if(F.col("planted") == d).alias("right"), F.count_if(F.col("planted").isin("none", *DEFECTS[DEFECTS.index(d) + 1 :])).alias("wrong")).collect()  # at most 3 ** number of functions
        if not seen_patterns:
            return out.select("row_key", "question", "answer", F.array().cast("array<struct<defect:string,posterior:double>>").alias("labels"))
        patterns = np.array([r[0] for r in seen_patterns])
        counts, right, wrong = (np.array([r[c] for r in seen_patterns], dtype=float) for c in ("n", "right", "wrong"))
        posterior, share, _ = fit_label_model(patterns, counts, np.array([o for _, o in fs.values()]))
        cutoff = best_cutoff(posterior, right, wrong, share)
        found = [(list(map(int, r[0])), float(x)) for r, x in zip(seen_patterns, posterior) if x >= cutoff]
        table = spark.createDataFrame(found, f"v_{d} array<int>, p_{d} double")
        out = out.join(F.broadcast(table), f"v_{d}", "left")  # as many rows as patterns at most
        kept.append(F.when(F.col(f"p_{d}").isNotNull(), F.struct((-F.col(f"p_{d}")).alias("order"), F.lit(d).alias("defect"), F.col(f"p_{d}").alias("posterior"))))
    labels = F.transform(F.array_sort(F.array_compact(F.array(*kept))), lambda x: F.struct(x["defect"].alias("defect"), x["posterior"].alias("posterior")))
    return out.select("row_key", "question", "answer", labels.alias("labels"))


def one_defect(found: DataFrame) -> DataFrame:
    """``row_key, defect`` for pairs with a label; of several the first in the order of :data:`DEFECTS` counts."""
    rank = F.array_min(F.transform("labels", lambda x: F.array_position(F.array(*map(F.lit, DEFECTS)), x["defect"])))
    return found.where(F.size("labels") > 0).select("row_key", F.element_at(F.array(*map(F.lit, DEFECTS)), rank.cast("int")).alias("defect"))
