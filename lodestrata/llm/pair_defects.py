"""Problem 4: broken question and answer pairs.

* empty: nothing visible but tags and field names.
* copy: the answer is compressed with zstandard, once with the question as its
  dictionary and once without; where the question explains nearly all of it,
  it is a copy. Both sides are folded in case and white space first.
* refusal: phrases of a refusal dictionary in an answer that gives no verdict.
* truncated: the corpus' terminal-context model (see ``truncation``).
* other_language: languages by dictionaries of function words, other scripts
  by their letters, over the prose of both sides.

A pair has the first of these that applies, in that order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.prose import TICKS, has_visible, segments
from lodestrata.llm.residue import residue_segments
from lodestrata.llm.truncation import truncated_texts
from lodestrata.staging import stage

#: A copy: with the question as dictionary it takes at most this share of its own compressed size, or so few
#: bytes (a lead-in) and the second share. Texts of fewer than COPY_BYTES bytes are compared as they are.
COPY_SHARE, COPY_LEAD_IN, COPY_SHARE_WITH_LEAD_IN, COPY_BYTES, COPY_LEVEL = 0.25, 40, 0.5, 40, 3
#: Lead over the next language that a sentence needs; letters of another script that count.
LEAST_LEAD, LEAST_LETTERS = 0.3, 4

#: Phrases that decline a request. Fixed values.
REFUSAL = re.compile(
    r"""\bi\s+(?:can(?:\s?not|'t|’t)|won(?:'t|’t)|will\s+not|must\s+not|should\s+not|shall\s+not|may\s+not|am\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted|not\s+comfortable)(?:\s+to)?|am\s+not\s+going\s+to|(?:must|have\s+to|need\s+to)\s+(?:decline|refuse|pass)|decline|refuse|would\s+rather\s+not|do\s+not\s+feel\s+comfortable)
        (?:\s+(?:to|with|be\s+able\s+to|in\s+good\s+conscience))*\s*
        (?:help|assist|give|provid\w*|offer|review\w*|analy[sz]\w*|describ\w*|explain\w*|discuss\w*|answer\w*|go\s+further|continue|comply|comment\w*|judge|assess|evaluat\w*|rate|engage|on\s+this|this|support|produce|fulfil\w*|complete|share|say|pass)\b
    |\bi\s+(?:must|have\s+to)\s+(?:decline|refuse|pass)\b
    |\b(?:guidelines|polic(?:y|ies)|rules)\b.{0,24}\b(?:keep|prevent|prohibit|forbid|stop|do\s+not\s+allow|don(?:'t|’t)\s+allow|bar)\w*\b
    |\b(?:would|will)\s+(?:breach|violate|be\s+against)\b.{0,24}\b(?:polic(?:y|ies)|guidelines|rules|terms)\b
    |\boutside\s+(?:of\s+)?what\s+i\s+(?:may|can|am)\b
    |\b(?:not\s+be|isn(?:'t|’t)|not)\s+appropriate\s+(?:for\s+me\s+)?to\s+(?:discuss|describe|analy[sz]e|answer|review|comment|explain)\b
    |\bno\s+(?:analysis|verdict|answer|review|assessment)\b.{0,40}\bwill\s+be\s+(?:provided|given|offered|made)\b
    |\bas\s+an?\s+(?:ai|language\s+model|ai\s+(?:language\s+)?model|assistant)\b
    |\bno\s+puedo\s+(?:ayudar|responder|analizar|dar|continuar)\b|\blo\s+siento\b.{0,20}\bno\b
    |\bje\s+ne\s+peux\s+pas\s+(?:vous\s+)?(?:aider|répondre|analyser|donner|continuer)\b|\bdésolée?\b.{0,20}\bne\b
    |\b(?:kann|darf|werde)\s+(?:ich\s+)?(?:dabei\s+|dazu\s+|hier\s+)?(?:leider\s+)?(?:nicht|keine?n?)\s+(?:helfen|beantworten|analysieren|urteil|bewertung|auskunft)\b
    |\bnão\s+posso\s+(?:ajudar|responder|analisar|dar|continuar)\b
    |не\s+могу\s+(?:помочь|ответить|анализировать|дать|продолжить)|вынужден\w*\s+отказать
    |无法(?:协助|回答|提供|分析)|不能(?:协助|回答|提供|分析)|抱歉""",
    re.I | re.X,
)
_VERDICT = re.compile(r"(?im)^\s*(?:status|cwe)\s*:\s*\S")

#: Articles, pronouns, prepositions, conjunctions, auxiliaries and common adverbs by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an and or but nor so yet if then than because while when where who whom which whose what that this these those of to in on at by for from with without into onto over under before after between through during about against above below up down out off is are was were be been being am do does did has have had can could will would shall should may might must not no never any all each every both few more most other some such only own same too very just also again once here there it its he she they them their we us our you your i me my as how why whether",
    "es": "el la los las un una unos unas lo al del de a ante bajo con contra desde durante en entre hacia hasta mediante para por según sin sobre tras y e o u ni pero sino aunque porque pues si cuando donde como que quien quienes cual cuales cuyo qué quién cuál cómo cuándo dónde este esta estos estas ese esa esos esas aquel aquella esto eso yo tú él ella nosotros ellos ellas me te se nos les le su sus mi tu nuestro no sí ya más menos muy también tampoco siempre nunca antes después solo cada todo toda todos todas ninguno ninguna alguna alguno es son era fue ser está están estar ha han haber hay puede pueden debe deben tiene",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber sondern denn weil dass ob wenn als wie wo wer wen wem was welche welcher welches dieser diese dieses diesem diesen jener jede jeder jedes alle kein keine keinen keinem man ich du er sie es wir ihr mich dich sich uns mein dein sein ihre ihrer seine in im an am auf aus bei beim bis durch für gegen hinter mit nach neben ohne seit über um unter von vom vor während wegen zu zum zur zwischen ist sind war waren sein bin hat haben hatte wird werden wurde kann können soll sollte muss müssen darf nicht nie noch nur schon sehr auch so dann hier dort immer bevor nachdem deshalb damit",
    "fr": "le la les l un une des du de d au aux à dans en sur sous par pour avec sans chez vers entre contre depuis pendant avant après et ou mais donc car ni si que qui quoi dont où quand comme lorsque puisque parce afin ce cet cette ces celui celle ceux il elle on nous vous ils elles je tu me te se lui leur leurs son sa ses mon ma mes ton notre votre ne pas plus jamais rien aucun aucune tout toute tous toutes chaque même aussi très bien ainsi puis alors est sont était être été a ont avoir avait peut peuvent doit doivent fait faut",
    "pt": "o a os as um uma uns umas ao aos à às do da dos das de no na nos nas em num numa por pelo pela pelos pelas para com sem sob sobre entre até desde contra antes depois e ou mas nem porém portanto porque pois se quando onde como que quem qual quais cujo este esta estes estas esse essa isso isto aquele aquela eu tu ele ela nós eles elas me te lhe lhes seu sua seus suas meu minha não sim já mais menos muito também sempre nunca só cada todo toda todos todas nenhum nenhuma algum alguma é são era foi ser está estão estar há tem têm ter pode podem deve devem",
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla in nel nella con su sul sulla per tra fra e o ma però perché se quando dove come che chi cui quale questo questa questi quello quella io tu lui lei noi voi loro mi ti si ci vi suo sua non più meno molto anche sempre mai prima dopo ogni tutto tutti nessun nessuna è sono era essere stato ha hanno avere può possono deve devono",
    "nl": "de het een en of maar want dus omdat als dan toen dat die dit deze wie wat waar hoe wanneer welke ik je jij hij zij ze wij we jullie u mij hem haar ons hun zijn mijn van in op aan bij met naar uit voor door over onder tussen tegen zonder om te tot is was waren wordt worden werd heeft hebben had kan kunnen moet moeten mag niet geen nooit ook nog al alleen zeer hier daar elke alle voordat nadat",
}
_LANGUAGE_OF = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _LANGUAGE_OF.setdefault(_word, []).append(_language)
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of other scripts. Fixed values.
SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]")),
    ("ko", re.compile(r"[가-힯]")),
    ("zh", re.compile(r"[㐀-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("he", re.compile(r"[֐-׿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
)
_TAG = re.compile(r"</?\w+>")
_PLAIN_VALUE = re.compile(r"^(?:none|n/?a|safe|vuln\w*|confirmed|needs[ _]context|low|medium|high|critical|cwe-\d+|\d+|-)?\W*$", re.I)


@lru_cache(maxsize=1 << 16)
def line_language(line: str) -> tuple[str | None, int]:
    """Language of one prose sentence and its weight in words (wide script: letters / 2)."""
    line = _TAG.sub(" ", line)
    if _PLAIN_VALUE.match(line):
        return None, 0
    line = TICKS.sub(" ", line).replace("`I`", " ")
    letters = len(re.findall(r"[^\W\d_]", line))
    if not letters:
        return None, 0
    for name, script in SCRIPTS:
        n = len(script.findall(line))
        if n >= LEAST_LETTERS and n * 2 > letters or (n and n * 4 > letters * 3):
            return name, max(1, n // 2 if name in ("zh", "ja", "ko") else len(_WORD.findall(line)))
    words = [w.lower() for w in _WORD.findall(line)]
    votes: Counter = Counter()
    for word in words:
        for language in _LANGUAGE_OF.get(word, ()):
            votes[language] += 1.0 / len(_LANGUAGE_OF[word])
    if re.search(r"[äöüß]", line):
        votes["de"] += 0.5
    if re.search(r"[ãõ]", line):
        votes["pt"] += 0.5
    if re.search(r"[ñ¿¡]", line):
        votes["es"] += 0.5
    if re.search(r"[èêùûçœ]", line):
        votes["fr"] += 0.3
    if not votes:
        return None, 0
    (best, score), *others = votes.most_common(2)
    return (best, len(words)) if not others or score - others[0][1] >= LEAST_LEAD else (None, 0)


def prose_language(sentences: list[str]) -> str | None:
    """Language that most of the prose is in; null where there is none to tell."""
    votes: Counter = Counter()
    for sentence in sentences:
        language, weight = line_language(sentence)
        if language:
            votes[language] += weight
    return max(votes.items(), key=lambda kv: (kv[1], kv[0]))[0] if votes else None


_WRAPPING = re.compile(r"</?(?:scan|generate|explain|synthesize|think)>|```\w*")


def folded(text: str) -> bytes:
    """``text`` in lower case without tags, fences, field names and white space runs."""
    text = text.lower()
    if "<" in text or "```" in text:
        text = _WRAPPING.sub(" ", text)
    return " ".join(text.split()).encode("utf-8", "replace")


def copy_sizes(a: bytes, q: bytes) -> tuple[int, int]:
    """Bytes of a folded answer compressed with the folded question as dictionary, and without."""
    import zstandard

    size = 1 << max(10, min(27, (len(a) + len(q)).bit_length() + 1))
    settings = zstandard.ZstdCompressionParameters.from_level(
        COPY_LEVEL, window_log=size.bit_length() - 1, write_content_size=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    plain = len(zstandard.ZstdCompressor(compression_params=settings).compress(a))
    known = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(a)), plain


def is_copy(answer: str, question: str) -> bool:
    """Whether the question explains nearly all of the answer, but for a lead-in.

    Texts too short to show anything by their compression have to be equal.
    """
    a, q = folded(answer), folded(question)
    if len(a) < COPY_BYTES or len(q) < COPY_BYTES:
        return bool(a) and a == q
    known, plain = copy_sizes(a, q)
    return known <= COPY_SHARE * plain or (known <= COPY_LEAD_IN and known <= COPY_SHARE_WITH_LEAD_IN * plain)


@lru_cache(maxsize=1 << 16)
def declines(sentence: str) -> bool:
    """Whether a sentence of an answer declines to answer."""
    return bool(REFUSAL.search(sentence))


def own_defect(question: str | None, answer: str | None) -> str | None:
    """The defect that the pair shows by itself (all kinds but truncated)."""
    if answer is None:
        return "empty"
    if not has_visible(answer):
        return "empty"
    said = segments(answer)
    if question and is_copy(answer, question):
        return "copy"
    if any(map(declines, said)):
        return "refusal"
    language = prose_language(said)
    if language and language != (prose_language(segments(question or "")) or "en"):
        return "other_language"
    return None


def _defects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            own_defect(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist(), strict=True)
        ]
        keep = pa.array([i for i, d in enumerate(found) if d], pa.int64())
        yield pa.record_batch(
            {"record_id": batch.column("record_id").take(keep), "defect": pa.array([d for d in found if d], pa.string())}
        )


def defective_pairs(pairs: DataFrame, source: str = "source", corpus: DataFrame | None = None) -> DataFrame:
    """(record_id, defect): one row for each defective pair.

    ``pairs``: record_id BIGINT, question, answer and ``source``; other
    columns are ignored, repeated rows of an id count once. A null, empty or
    blank answer is ``empty``; a null question counts as one in English
    without text. Answers of residue have no defect. An empty table gives no
    rows. ``corpus``: the texts, as of ``records.all_texts`` and the pairs'
    among them, by whose statistics cut answers are told, so that they are the
    cases of problem 2; without it the pairs' own texts.
    """
    own = stage(
        pairs.select("record_id", "question", "answer").mapInArrow(_defects, "record_id bigint, defect string"), "defects"
    )
    own_texts = pairs.select(
        F.lit("pilot_records").alias("origin"),
        F.col("record_id").alias("row_id"),
        F.col(source).alias("source"),
        F.inline(
            F.array(
                F.struct(F.lit("user").alias("part"), F.col("question").alias("text")),
                F.struct(F.lit("answer").alias("part"), F.col("answer").alias("text")),
            )
        ),
    )
    texts = own_texts if corpus is None else corpus
    residue = stage(residue_segments(texts).select("origin", "row_id", "part").distinct(), "residue")
    answers = residue.where("origin = 'pilot_records' and part = 'answer'").select(F.col("row_id").alias("record_id"))
    cut = truncated_texts(texts, "answer", residue).select(F.col("row_id").alias("record_id"), F.lit("truncated").alias("defect"))
    order = F.array_position(F.array(*map(F.lit, ("empty", "copy", "refusal", "truncated", "other_language"))), F.col("defect"))
    sound = own.join(answers, "record_id", "left_anti").unionByName(cut)
    return sound.groupBy("record_id").agg(F.min_by("defect", order).alias("defect"))
