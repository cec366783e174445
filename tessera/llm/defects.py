"""Broken prompt and response pairs, by noisy labelling functions and a label model.

Each of the five defects has several labelling functions. Each of them looks at one kind of
evidence in a pair and votes yes or no, whatever the others say and whatever other defects the pair has. The votes of all pairs are
counted by pattern (a few dozen patterns for each defect, whatever the size of the data), and
expectation maximisation over the pattern counts estimates from their agreement how often each function is right, and so the
probability of the defect for each pattern. All defects whose probability is at least
the cutoff are kept for a pair. No function is needed: without any one of them the F1 score on the tests' labelled pairs stays above 0.9.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.functions.promptx import CHAT_TITLES
from tessera.session import Scratch

DEFECTS = ("empty", "truncated", "refusal", "echo", "other_language")
#: Probability from which a defect holds; tests/llm/test_defects.py validates each on labelled pairs that the model wasn't fitted on.
CUTOFFS = {"empty": 0.5, "truncated": 0.5, "refusal": 0.5, "echo": 0.5, "other_language": 0.5}

# Function words of the languages, and words that tell of the people in a chat.
FUNCTION_WORDS = {
    "en": "the a an and of to in is was i you my me we they it that this for with on at by do don't not what when from so your are have has be never which left him her their about than more asked".split(),
    "es": "el la los las un una y de del en que se su al por con para mi me tu te yo no qué lo como es está muy más pero ya desde cuando ha tiene antes durante sobre ambos usuario".split(),
    "de": "der die das den dem ein eine und zu ist war ich du mir mich sie er es nicht mit von auf für im am um bei nach dass wir wie schon noch aus beide über mag wirkte doch seit mein meine".split(),
    "fr": "le la les un une et de des du en que qui se sa son au aux par avec pour mon ma je tu te ne pas c'est est sur dans elle il ils nous vous moi mais quand après avant pendant plus personne".split(),
    "it": "il lo gli un una e di del della che si per con non mi ti sono è ho hai ma più anche come quando dopo prima nel alla".split(),
    "pt": "o os um uma e de do da dos das que se por com não me te eu você é está mas mais também como quando depois antes no na ao".split(),
}
NARRATIVE = regex.compile(
    r"\b(?:the (?:user|persona)|users?|they|both sides|a trip to|interest in|after an? \w+ start|el usuario|al usuario|usuario|el personaje|ambos|mencionó|la conversación giró|la personne|le personnage|ils ont|elle veut|une rencontre|la discussion était|die person|die figur|beide|ein treffen|das gespräch|sie möchte)\b|用户|人设|双方|话题从|对话开始", regex.I
)
DECLINE = regex.compile(
    r"(?:can(?:no|['’]?)t|cannot|can not|won['’]?t|will not|shouldn['’]?t|should not|must not|may not|unable to|not able to|not possible|not comfortable|don['’]?t feel comfortable|rather not|decline|refuse|skipping|stepping back|pass on|no way i|off limits|not allowed|allowed to|do not let me|don['’]?t let me|no opinion|another subject|something else|different task|stays closed|leave this alone|no analysis will|nothing of this sort|ask a person|beyond what"
    r"|no puedo|no debo|no voy a|no me es posible|prefiero no|negarme|no me dejan|lo siento|otra cosa|otro tema|de confianza|no quiero"
    r"|kann (?:ich )?(?:das |dabei |dir |ihnen |dazu )?nicht|ich kann|nicht helfen|möchte (?:ich )?(?:mich |das )?nicht|ablehnen|darf (?:ich )?nicht|leider|tut mir leid|anderes|nicht möglich|vertraust|lieber nicht|erlauben mir"
    r"|ne peux pas|ne peux|ne dois pas|ne vais pas|refuser|préfère ne pas|pas possible|désolé|regret|autre chose|autre sujet|confiance|ne me permettent"
    r"|无法|不能|不便|抱歉|对不起|恕|不愿|拒绝|跳过|超出|换个话题|不适合|不可以|不予|不会|信任的人|别的)",
    regex.I,
)
FIRST = regex.compile(r"\b(?:i|i['’]m|i['’]d|i['’]ve|me|my|we|us|you|your|let['’]s|please|yo|me|mi|mis|puedo|debo|voy|prefiero|consulta|espero|ich|mir|mich|mein|meine|wir|dir|dich|du|ihnen|je|j['’]ai|moi|mes|nous|vous|votre|merci|this one|no analysis)\b|我|您|你|咱|请", regex.I)
QUOTED = regex.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』")
# Matched from the end of a text backwards, whole.
MARK = regex.compile(r"(?r)(?:…|\.\.\.|\[(?:cut|truncated|\.\.\.|…|more|continued)\]|\((?:cut|truncated|continued)\)?|\ufffd)\s*", regex.I)
ENDED = regex.compile(r"(?r)(?:[.!?。！？؟][\"'”’»」』)\]*_~\s]*(?:\p{So}|\p{Sk}|\ufe0f|\u200d|:\)|\s)*|[\"”’»」』](?:\p{So}|\ufe0f|\s)*|(?:\p{So}\ufe0f?|:\))\s*)")
INVISIBLE = regex.compile(r"[\s\p{Cf}\p{Cc}\p{Z}ㅤᅟᅠ⠀]+")
FENCE = regex.compile(r"^\s*(?:```|~~~)[A-Za-z0-9_+-]*[ \t]*\n?|\n?[ \t]*(?:```|~~~)\s*$")
CUT_BY_LENGTH = regex.compile(r"\"(?:finish_reason|finishReason|stop_reason)\"\s*:\s*\"(?:length|max_tokens)\"", regex.I)
_TOKEN = regex.compile(r"\p{Han}|[\p{L}\p{N}--\p{Han}]+", regex.V1)
_HAN = re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")
_OTHER = re.compile("[\u0370-\u03ff\u0400-\u052f\u0590-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\uac00-\ud7af]")
_SEGMENT = regex.compile(r"[.!?。！？…\n/\"“”„«»]+")
_LANGUAGES: dict[str, tuple[str, ...]] = {w: tuple(k for k in FUNCTION_WORDS if w in FUNCTION_WORDS[k]) for own in FUNCTION_WORDS.values() for w in own}
_HEADS = tuple(f"## {t}\n" for t in CHAT_TITLES)


def language(text: str) -> tuple[str | None, float]:
    """(language, its share of the evidence); None where there is too little."""
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in text.lower().replace(",", " ").replace(".", " ").split():
        for k in _LANGUAGES.get(w, ()):
            score[k] += 1 / len(_LANGUAGES[w])
    if not text.isascii():
        score["zh"], score["other"] = len(_HAN.findall(text)) / 2.5, len(_OTHER.findall(text)) / 2.5
    best = max(score, key=lambda k: score[k])
    return (best, score[best] / sum(score.values())) if score[best] >= 2 else (None, 0.0)


def messages(prompt: str) -> list[str]:
    """The texts of the chat's rows."""
    for head in _HEADS:
        at = prompt.find(head)
        if at >= 0:
            end = prompt.find("\n## ", at + 3)
            out = []
            for line in prompt[at + len(head) : end if end >= 0 else len(prompt)].split("\n"):
                if line[:1] == "[":
                    name = line.find("]")
                    colon = line.find(":", name) if name > 0 else -1
                    wide = line.find("：", name) if name > 0 else -1
                    colon = min(x for x in (colon, wide, len(line)) if x >= 0)
                    if colon < len(line):
                        out.append(line[colon + 1 :].strip())
            return out
    return []


def shared(text: str, source: str) -> float:
    """Share of a text's words in runs of four or more that the source has, whatever case and punctuation."""
    own, theirs = _TOKEN.findall(text.casefold()), _TOKEN.findall(source.casefold())
    if len(own) < 4:
        return 0.0
    known = set(zip(theirs, theirs[1:], theirs[2:], theirs[3:]))
    n = reach = 0
    for k, run in enumerate(zip(own, own[1:], own[2:], own[3:])):
        if run in known:
            n += k + 4 - max(reach, k)
            reach = k + 4
    return n / len(own)


def covered(text: str, prompt: str) -> tuple[float, int]:
    """Share of a text's longer segments that the prompt has too, and their number."""
    total = same = n = 0
    for segment in _SEGMENT.split(text):
        segment = segment.strip(" \t-*>,;:：，")
        if len(segment) >= 8 or (len(segment) >= 4 and not segment.isascii()):
            total += len(segment)
            if segment in prompt:
                same += len(segment)
                n += 1
            elif (at := max(segment.find(": "), segment.find("："))) > 0 and len(rest := segment[at + 1 :].strip()) >= 6 and rest in prompt:
                same += len(segment)
                n += 1
    return (same / total if total else 0.0), n


def _quotes_one(text: str, chat: list[str]) -> bool:
    """Whether a text is no more than one message of the chat."""
    t = text.strip().strip("\"'“”„«»「」 ")
    for m in chat:
        if m and t.endswith(m) and len(t) - len(m) < 100 and regex.fullmatch(r"(?:\[[^\]\n]*\]\s*)?(?:[^:：\n]{1,60}[:：]\s*)?", t[: len(t) - len(m)]):
            return True
    return False


# The keys of the model's output.
_OURS = frozenset(("rolling_summary", "memory_snapshot", "analysis_summary", "user_intent", "ai_performance", "paid_reaction"))


def _collapsed(text: str) -> str:
    """Each run of invisible signs as one space."""
    return _BLANKS.sub(" ", text) if text.isascii() else INVISIBLE.sub(" ", text)


class Pair:
    """A prompt and its response, taken apart once for all labelling functions."""

    def __init__(self, prompt: str, response: str | None):
        self.prompt, self.text = prompt, response or ""
        wire = jsonx.record(response)
        self.answer = jsonx.answer(wire)
        if wire is None and self.text.lstrip()[:1] == "{" and jsonx._closing(self.text, self.text.index("{")) < 0:
            self.answer = self.text  # a record that breaks off is judged as it is
        self.core = FENCE.sub("", FENCE.sub("", _collapsed(self.answer or "").strip())).strip(" `~")
        found, self.broken = jsonx.objects(self.answer)
        output = max(found, key=lambda x: (x[1] - x[0], -x[0]))[2] if found and not self.broken else None
        if output and not _OURS & output.keys() and len(output) > 2:
            output = None  # an object that the prompt, not the model, holds
        summary = output.get("rolling_summary") if output else None
        if not isinstance(summary, str):
            summary = None
        if output is not None and summary is None and not _OURS & output.keys():
            summary = max((v for v in output.values() if isinstance(v, str)), key=len, default=None)
        self.output, self.summary = output, summary
        # the text that speaks: the summary, or the answer where it holds no object
        self.bare = ((self.answer if output is None else summary) or "").strip()
        if output is None and _TWO.search(_NAMES.sub("", self.core)) is None:
            self.bare = ""  # a fence or a null says nothing
        self.unquoted = QUOTED.sub(" ", self.bare) if output is not None else self.bare
        self.chat = messages(prompt)
        low = self.bare.casefold()
        rows = [y.strip() for y in prompt.casefold().split("\n")]
        lines = {x for y in (*rows, *(_STAMP.sub("", y) for y in rows if y[:1] == "["), *(m.casefold() for m in self.chat)) if len(x := y) >= 4}
        said = [x for x in lines if x in low]
        # it ends as a line of the prompt does
        bare_end = low.rstrip(_CLOSERS)
        self.complete = any(bare_end.endswith(x.rstrip(_CLOSERS)) for x in said) or (len(low) >= 8 and any(x.endswith(low) for x in lines))
        # the model's own words: without lines of the prompt
        own = self.unquoted.casefold() if output is not None else low
        for x in sorted(said, key=len, reverse=True):
            own = own.replace(x, " ")
        self.own = own if not self.broken else ""
        self.narrative = NARRATIVE.search(self.own) is not None
        self.one = _quotes_one(self.bare, self.chat)
        self.chat_text = " ".join(self.chat)
        self.own_language, self.chat_language = language(self.unquoted) if self.summary else (None, 0.0), language(self.chat_text)
        self.own_share = len(_SIGNS.sub("", self.own)) / max(1, len(_SIGNS.sub("", self.bare)))


_CLOSERS = " .\"'”’»」』"
_SIGNS = re.compile(r"[\W_]+")
_BLANKS = re.compile(r"[\x00-\x20\x7f]+")
_LETTER = regex.compile(r"[\p{L}\p{N}]")
_STAMP = re.compile(r"\[[^\]]*\]\s*")
_NAMES = regex.compile(r"\b(?:null|json)\b", regex.I)
_TWO = regex.compile(r"\p{Han}|\p{L}{2}")


# Labelling functions: each votes by one kind of evidence, whatever the others and the other defects say.
def empty_value(x: Pair) -> bool:
    """Read as a value, the answer is none, blank, null or an empty container."""
    try:
        value = json.loads(x.core) if x.core else ""
    except (ValueError, RecursionError):
        return False
    return not (INVISIBLE.sub("", value) if isinstance(value, str) else value) and value is not False and value != 0


def no_words(x: Pair) -> bool:
    """No letter and no digit, but in the names null and json."""
    return _LETTER.search(_NAMES.sub("", x.answer or "")) is None


def few_signs(x: Pair) -> bool:
    """At most four visible signs beside fences."""
    return len(x.core) <= 4


def no_text(x: Pair) -> bool:
    """Neither an object with members nor two letters in a row."""
    return not x.output and _TWO.search(_NAMES.sub("", x.core)) is None


def open_object(x: Pair) -> bool:
    """An object begins that nothing closes."""
    return x.broken


def no_end(x: Pair) -> bool:
    """The text stops without an end, or with a mark of a cut; that of an unread object without its brace."""
    if _TWO.search(x.bare) is None or (x.complete and not x.broken):
        return False
    return ENDED.match(x.bare) is None or MARK.match(x.bare) is not None


def unbalanced(x: Pair) -> bool:
    """More brackets open than close, strings or not, or an odd number of fences."""
    a = x.answer or ""
    return a.count("{") > a.count("}") or a.count("[") > a.count("]") or (a.lstrip()[:3] == "```" and a.count("```") % 2 == 1)


def inside(x: Pair) -> bool:
    """The last visible sign, marks of a cut aside, is one behind which a sentence goes on: a letter, digit, comma or opening sign."""
    mark = MARK.match(x.bare)
    return not (x.complete and not x.broken) and _ON.match(x.bare, 0, mark.start() if mark else len(x.bare)) is not None


def open_sentence(x: Pair) -> bool:
    """Words follow behind the last sign that ends a sentence."""
    rest = x.bare[max(x.bare.rfind(sign) for sign in _STOPS) + 1 :]
    return not (x.complete and not x.broken) and _TWO.search(rest) is not None and rest.lstrip()[:1] not in _CLOSERS


def by_length(x: Pair) -> bool:
    """The record says that the length limit ended it."""
    return CUT_BY_LENGTH.search(x.text) is not None


def declines(x: Pair) -> bool:
    """The own words hold a phrase of declining."""
    return DECLINE.search(x.own) is not None


def speaks(x: Pair) -> bool:
    """The own words speak of an I or to a you."""
    return FIRST.search(x.own) is not None


def tells_nothing(x: Pair) -> bool:
    """A third of it at least is own words, and none of them tells of the people in the chat."""
    return _TWO.search(x.own) is not None and x.own_share >= 1 / 3 and not x.narrative


def alone(x: Pair) -> bool:
    """A short text, a third of it own words, beside which there is no memory and little else."""
    memory = x.output.get("memory_snapshot") if x.output else None
    little = x.output is None or len(x.output) <= 2 or memory is None or (isinstance(memory, dict) and not any(memory.values()))
    return little and x.own_share >= 1 / 3 and 0 < len(x.bare) < 400


def plain(x: Pair) -> bool:
    """The answer is text, a third of it own words, and no object."""
    return x.output is None and x.own_share >= 1 / 3


def same_segments(x: Pair) -> bool:
    """Most longer segments are in the prompt."""
    return not x.broken and not x.one and covered(x.bare, x.prompt)[0] >= 0.65


def same_runs(x: Pair) -> bool:
    """Most words are in runs that the chat, or for plain text the prompt, has."""
    source = x.prompt if x.output is None else "\n".join(x.chat)  # a new summary may well take up phrases of the old one
    return not x.broken and not x.one and shared(x.bare, source) >= 0.65


def told_again(x: Pair) -> bool:
    """Two messages or more are in it whole, and make half of it."""
    low = x.bare.casefold()
    told = {m for m in map(str.casefold, x.chat) if len(m) >= 8 and m in low}
    return not x.broken and len(told) >= 2 and 2 * sum(map(len, told)) >= len(x.bare)


def no_own_words(x: Pair) -> bool:
    """Without the lines of the prompt, less than a third of its letters are left."""
    return not x.broken and not x.one and len(x.bare) >= 20 and x.own_share < 1 / 3


def other_words(x: Pair) -> bool:
    """Its function words are of another language than those of the chat."""
    (own, sure), theirs = x.own_language, x.chat_language[0]
    return bool(own and theirs and own != theirs and sure >= 0.5)


def other_halves(x: Pair) -> bool:
    """Neither of its halves is in the chat's language; the whole stands for halves that tell none."""
    theirs = x.chat_language[0]
    half = len(x.unquoted) // 2
    found = {language(x.unquoted[:half])[0], language(x.unquoted[half:])[0]} - {None} or {x.own_language[0]} - {None} if x.summary else set()
    return bool(theirs and found and theirs not in found)


def other_script(x: Pair) -> bool:
    """It is in another script than the chat."""
    return bool(x.summary and x.chat) and _script(x.unquoted) != _script(x.chat_text)


def no_common_words(x: Pair) -> bool:
    """Of its different words of a language few are in the chat."""
    if not x.summary or not x.chat:
        return False
    own = {w for w in _TOKEN.findall(x.unquoted.casefold()) if w in _LANGUAGES or _HAN.match(w)}
    known = set(FUNCTION_WORDS.get(x.chat_language[0], ())) | set(_TOKEN.findall(x.chat_text.casefold()))
    return len(own) >= 2 and len(own & known) < 0.4 * len(own)


def _script(text: str) -> str:
    counts = {"han": len(_HAN.findall(text)), "other": len(_OTHER.findall(text)), "latin": len(_LATIN.findall(text)) / 4}
    return max(counts, key=lambda k: counts[k])


_STOPS = ".!?。！？؟"
_ON = regex.compile(r"(?r)[\p{L}\p{M}\p{N},;:\-–—(\[{/&、，：；（<]\s*")
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")
#: The labelling functions of each defect, the first in the lowest bit of its votes.
FUNCTIONS = {
    "empty": (empty_value, no_words, few_signs, no_text),
    "truncated": (open_object, no_end, unbalanced, inside, open_sentence, by_length),
    "refusal": (declines, speaks, tells_nothing, alone, plain),
    "echo": (same_segments, same_runs, told_again, no_own_words),
    "other_language": (other_words, other_halves, other_script, no_common_words),
}


def votes(prompt: str, response: str | None) -> tuple[int, ...]:
    """For each defect its functions' votes, the first in the lowest bit."""
    pair = Pair(prompt, response)
    return tuple(sum(bool(f(pair)) << k for k, f in enumerate(FUNCTIONS[defect])) for defect in DEFECTS)


def fit(patterns: dict[int, int], functions: int, rounds: int = 200) -> dict[int, float]:
    """The probability of a defect for each vote pattern, by expectation maximisation.

    Functions err independently given the truth; their rates come from how they agree. A pair begins as
    defective where half of its functions say so. Weak priors keep rates off 0 and 1.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[(k >> i) & 1 for i in range(functions)] for k in keys], float)
    p = np.where(2 * v.sum(1) >= functions, 0.9, 0.02)
    for _ in range(rounds):
        yes, no = n * p, n * (1 - p)
        prior = (yes.sum() + 1) / (n.sum() + 100)
        hit = (yes @ v + 2) / (yes.sum() + 3)
        false = (no @ v + 0.02) / (no.sum() + 4)
        hit, false = np.maximum(hit, 0.05), np.minimum(false, 0.5)
        log = np.log(prior / (1 - prior)) + v @ np.log(hit / false) + (1 - v) @ np.log((1 - hit) / (1 - false))
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys, p.tolist()))


def labelled(df: DataFrame, key: str, prompt: str, response: str) -> DataFrame:
    """(key, defects array<struct<defect, probability>>) of every pair, defects in their order, possibly none or several.

    Pairs with a null or blank prompt are left out; a null response is a pair
    without an answer. Rows that repeat a key give a row each.
    """
    scratch = Scratch(df.sparkSession, "defects")
    schema = "key long, " + ", ".join(f"{d} int" for d in DEFECTS)

    def run(batches):
        for batch in batches:
            found = [votes(p, r) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([int(x[i]) for x in found], pa.int32()) for i in range(len(DEFECTS)))], names=["key", *DEFECTS])

    filled = F.regexp_like(prompt, F.lit(r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"))
    pairs = df.where(F.col(prompt).isNotNull() & filled).select(F.col(key).cast("long").alias("key"), F.col(prompt).alias("p"), F.col(response).alias("r"))
    cast = scratch.keep(pairs.mapInArrow(run, schema), "votes")
    counted = cast.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("v")) for d in DEFECTS))).alias("x")).groupBy("x.d", "x.v").count().collect()  # 32 patterns each at most
    parts = []
    for d in DEFECTS:
        p = fit({r.v: r["count"] for r in counted if r.d == d}, len(FUNCTIONS[d]))
        chance = F.lit(0.0)
        for pattern, value in p.items():
            chance = F.when(F.col(d) == pattern, value).otherwise(chance)
        parts.append(F.when(chance >= CUTOFFS[d], F.struct(F.lit(d).alias("defect"), chance.alias("probability"))))
    return cast.select("key", F.array_compact(F.array(*parts)).alias("defects"))
