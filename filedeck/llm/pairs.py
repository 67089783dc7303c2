"""Defective question and answer pairs.

Each answer is looked at in this order, and gets the first defect that fits:
`empty`      nothing is left after labels, punctuation and invisible characters, or a stand-in for "nothing";
`copy`       a walk of the answer through the question's suffix automaton covers nearly all of it, and
             nearly all of the question (the start of a question alone is a broken-off answer, no copy);
`refusal`    no value besides the question's own, and an automaton of refusals finds a phrase: set phrases, and every
             combination of what can be done with a value and how that is denied, in ten languages;
`truncated`  an opened delimiter is never closed, or the last line ends neither as a sentence nor as a value;
`language`   votes of function words and scripts go to another language than the question's, and none to it;
             names and words of the question, units and a lone foreign term have no vote.

A null or blank answer is empty; with a null question nothing is a copy or in a wrong language. Very
long answers are walked once, character by character. Repeated rows get equal results. Whatever other
columns say (a flag that the answer is correct, for one) is not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels before an answer, stand-ins for "nothing", phrases of refusal (letters and digits
# only), units, and function words of each language.
LABEL = re.compile(r"^[\s\"'“‘(\[*]*(?:답변|답|질문|정답|응답|question|answer|q|a)\s*[.:：)]\s*", re.IGNORECASE | re.MULTILINE)
NOTHING = frozenset("null none nil nan na n/a undefined unknown 없음 해당없음 해당사항없음 무응답 미기재 空 無 无 なし ninguno keine ninguna".split())
REFUSALS = """
수없습니다 수없음 수없는점 수없다 수없어 수없으 수없겠 수없네 알수없 확인불가 답변불가 제공불가 산출불가 불가능합니다 불가능함 불가능하 불가합니다 불가함
어렵습니다 어려운점 어렵다 어려움 어려울것 찾지못 파악하지못 확인하지못 확인되지않 제공되지않 드리지못 하지못합니다 하지못했 하지못하였 못합니다 못했습니다 못하였습니다
답변하지않 답을드리지않 제공하지않 않는것이적절 범위를벗어 양해바랍니다 양해부탁 죄송 포함되어있지않 나와있지않 기재되어있지않 언급되어있지않 정보가없 자료가없 근거가없 정보가부족 근거가부족
cannot cant unableto notable notenough insufficient donotcontain doesnotcontain doesnotprovide donotprovide notavailable notprovided notdisclosed notspecified notfound noinformation nodata couldnot sorry apologize declineto
nopuedo nosepuede nodispon losiento nocontiene kannnicht leidernicht nichtmöglich nichtenthalten keineangabe 无法 無法 不能提供 抱歉 没有提供 未提供 できません 申し訳 わかりません 見つかりません ありません
silenton saysnothing undisclosed unknownto beyondthescope outsidethescope beyondmy mustdecline regretthat 알수가없 나타나있지않 나타나지않 곤란합니다 곤란함 곤란하다 답이없 알려진바없 확인된바없 공개된바없 언급이없 기록이없 비공개
недоступн неизвестн несодержит неуказан неудалось немогу невозможно нераскры информацииотсутств jenepeuxpas nepeutpas nestpasdisponible nestpasindiqu nestpasmentionn aucuneinformation aucunedonnée désolé impossiblede
nonèdisponibile nonèstato nonèpossibile nonposso nessunainformazione mispiace nãoépossível nãoestádisponível nãoconsta nãoposso seminformação desculpe nohayinformación nohaydatos noestádisponible noseindica nosemenciona nichtverfügbar nichtangegeben nichtbekannt keineinformation keinedaten
不明です 不明である 記載がな 記載されていな 情報がな データがな 公表されていな 開示されていな お答えでき 確認でき 没有披露 未披露 未公开 没有说明 未说明 没有信息 没有数据 不得而知 不清楚 无从 查不到 找不到
""".split()
# What can be done with a value, and how that is denied; each joined to each, with and without the words between.
DENIED = (
    ("공개 기재 언급 명시 표시 제시 포함 수록 제공 확인 보고 기록 공시 안내 발견 파악 산출 계산 답변 판단 특정 도출".split(), "된바없 된바가없 되지않 되어있지않 돼있지않 할수없 할수가없 하지못 되지못 이불가 하기어렵 이어렵 된것이없 된내용이없 된자료가없 된정보가없 하기힘들".split()),
)
NEGATED = {
    "not isnt arent wasnt werent hasnt havent never": ("", "been", "be", "publicly", "currently", "explicitly", "directly", "yet", "beenpublicly", "separately"),
    "disclosed reported available provided specified stated mentioned listed given found included contained shown known published determined indicated recorded covered": (),
}
UNABLE = ("cannot cant couldnot couldnt unableto notableto failedto declineto refuseto donotknowhowto".split(), "answer provide determine find tell say confirm give disclose share identify locate calculate help assist comment verify derive".split())
LACKING = ("doesnot doesnt donot dont didnot didnt".split(), "contain provide include mention state disclose specify report show say list give cover reveal know have".split())
NO = ("no thereisno thereareno lacks without".split(), "information data figure figures mention record disclosure answer details indication evidence suchvalue".split())
UNITS = frozenset("""원 천원 백만원 억원 조원 만원 십억원 百万원 千원 억 조 만 won wons wones krw usd thousand million millions millionen billion tausend mil miles millones percent prozent 百万 千 億 亿
百万ウォン 千ウォン ウォン 百万韩元 千韩元 韩元 韓元 ウォンで k-ifrs ifrs""".split())
WORDS = {
    "en": frozenset("the of and to in is was were for it its on by from with at this that according reported amounted stood which has had based company filing annual report not".split()),
    "de": frozenset("der die das und ist war für laut im in nach auf den dem ein eine von zum betrug bericht meldete wurde beträgt unternehmen".split()),
    "es": frozenset("el la los las de del en que un una según informe fue por es para cifra empresa al se con".split()),
    "fr": frozenset("le la les des du de un une est était ont été dans pour par sur selon au aux et société chiffre d'affaires".split()),
    "it": frozenset("il lo la gli le di del della dei delle un una è stato stata sono nel nella per con secondo società che".split()),
    "pt": frozenset("o a os as do da dos das de um uma é foi são no na nos nas por para com segundo empresa que em".split()),
    "nl": frozenset("de het een van en is was in op voor met volgens bedrijf bedroeg dat zijn".split()),
}
#: Languages whose words settle what a question is asked in; the others are only told in answers.
ASKED = ("en", "de", "es")
# Scripts that none of these languages is written in.
SCRIPTS = regex.compile(r"\p{Cyrillic}|\p{Greek}|\p{Arabic}|\p{Hebrew}|\p{Thai}|\p{Devanagari}|\p{Bengali}|\p{Tamil}|\p{Georgian}|\p{Armenian}|\p{Khmer}|\p{Lao}|\p{Myanmar}|\p{Ethiopic}")
OPENING, CLOSING = "([{“‘「『《〈（［", ")]}”’」』》〉）］"
FINAL = re.compile(r"(?:다|요|까|음|임|함|됨|죠|네|불가|없음)[\s\"'”’)\]*]*$")
STOP = re.compile(r"[.!?。！？][\s\"'”’)\]*]*$")
NUMBER = r"\(?-?[\d][\d,.]*\)?"
VALUE_END = re.compile(rf"{NUMBER}\s*(?:(?:thousand|million|billion|백만|천|만|억|조|百万|千|십억)\s*)?(?:원|won|krw|%|percent|韩元|ウォン|달러)\s*(?:\([^()]*\))?[\s*\"'”’.]*$", re.IGNORECASE)
BARE = re.compile(rf"^[\s*\"'“(]*{NUMBER}[\s*\"'”)]*$")
GOING_ON = re.compile(r"이며|이고|하였고|였고|으나|지만|하며|there|which|while|, (?:and|but)", re.IGNORECASE)
VALUE = re.compile(r"\d{1,3}(?:,\d{3})+|\d{5,}|\d[\d,.]*\s*(?:조|억|백만|천|만|百万|千)?\s*(?:원|won|韩元|ウォン)|\d[\d,.]*\s*(?:thousand|million|billion|trillion|조|억|백만)\b|[$€¥₩]\s*\d", re.IGNORECASE)


class SuffixAutomaton:
    """The suffix automaton of a text: every path from the root spells a part of it."""

    def __init__(self, text: str):
        self.next, self.link, self.length = [{}], [-1], [0]
        last = 0
        for ch in text:
            now = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][ch]
                if self.length[q] > self.length[p] + 1:
                    copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[now] = q
            last = now

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length)
        return len(self.next) - 1

    def walk(self, text: str, least: int) -> tuple[int, int]:
        """(characters of text inside common parts of at least `least` characters, length of the longest such part)."""
        state = n = covered = longest = 0
        done = 0  # text[:done] is counted
        for i, ch in enumerate(text, 1):
            while state and ch not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if ch in self.next[state]:
                state, n = self.next[state][ch], n + 1
            else:
                n = 0
            longest = max(longest, n)
            if n >= least:
                covered += i - max(done, i - n)
                done = i
        return covered, longest


def letters(text: str) -> str:
    """Letters and digits only, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


def phrases() -> set[str]:
    """All phrases of refusal, as letters and digits."""
    out = set(REFUSALS)
    for heads, tails in (*DENIED, UNABLE, LACKING):
        out |= {h + t for h in heads for t in tails}
    (nots, between), (done, _) = NEGATED.items()
    out |= {n + b + d for n in nots.split() for b in between for d in done.split()}
    # "no" alone is too short to be told from the end of another word
    return out | {h + t for h in NO[0][1:] for t in NO[1]} | {"thereis" + h + t for h in NO[0][:1] for t in NO[1]}


@cache
def refusal_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in phrases():
        a.add_word(phrase, phrase)
    a.make_automaton()
    return a


def is_open(text: str) -> bool:
    """Whether a delimiter stays open at the text's end."""
    stack = []
    for c in text:
        if c in OPENING:
            stack.append(CLOSING[OPENING.index(c)])
        elif c in CLOSING and stack and stack[-1] == c:
            stack.pop()
    return bool(stack) or text.count("**") % 2 == 1


def is_truncated(answer: str) -> bool:
    text = answer.strip()
    if is_open(text) or re.search(r"[,:;·，、：]$", text) or re.search(r"(?:\.\.\.|…)$", text):
        return True
    line = text.split("\n")[-1].strip()
    sentence = re.split(r"(?<=[.!?。])\s+", line)[-1]
    if STOP.search(text):
        return bool(re.search(r"[\s(]\d+\.$", sentence) and re.search("[가-힣]", sentence))  # a decimal point
    if BARE.match(line) or FINAL.search(text):
        return False
    if GOING_ON.search(sentence) or re.search(r"\d$", text):
        return not re.fullmatch(rf"[^:]*:\s*{NUMBER}", sentence)
    return not (VALUE_END.search(sentence) or line.endswith((")", "）")) and re.search("[:：]", line))


def votes(text: str, question: str) -> dict[str, int]:
    """Votes for languages by words that are no part of the question, no unit and no number."""
    out: dict[str, int] = {}
    names = {w for w in re.findall(r"[^\W\d_]+", question.lower())}
    for word in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text.lower()):
        if word in UNITS or word in names:
            continue
        for name in names:
            if len(name) > 3 and name[:4] in word and re.match(r"[가-힣]", name):
                word = word.replace(name, "").replace(name.rstrip("의이가은는"), "")
        if not word or word in UNITS:
            continue
        if re.search(r"[ぁ-ヿ]", word):
            out["ja"] = out.get("ja", 0) + 2
        elif re.search(r"[가-힣]", word):
            if len(word) > 1:
                out["ko"] = out.get("ko", 0) + 2
        elif re.search(r"[一-鿿]", word):
            out["zh"] = out.get("zh", 0) + 2
        elif SCRIPTS.search(word):
            out["other"] = out.get("other", 0) + 2
        else:
            for lang, known in WORDS.items():
                if word in known:
                    out[lang] = out.get(lang, 0) + 2
            if not any(word in known for known in WORDS.values()):
                out["latin"] = out.get("latin", 0) + 1
    return out


def question_language(question: str) -> str:
    """The language of most votes; Hangul names in a sentence of another language do not count."""
    words = re.findall(r"[^\W\d_]+", question.lower())
    n = {lang: sum(w in WORDS[lang] for w in words) for lang in ASKED}
    n["en"] += sum(w in ("what", "how", "much", "please", "state", "did", "report") for w in words)
    if max(n.values()) >= 2:
        return max(n, key=n.get)
    scripts = {"ja": "[ぁ-ヿ]", "ko": "[가-힣]", "zh": "[一-鿿]"}
    return next((lang for lang, pattern in scripts.items() if re.search(pattern, question)), "en")


def in_other_language(question: str, answer: str) -> bool:
    own, n = question_language(question), votes(answer, question)
    latin = n.pop("latin", 0)
    if own in WORDS:
        return not n.get(own) and not latin and sum(n.values()) > 0 or max(n.values(), default=0) > n.get(own, 0) + latin
    if n.get(own):
        return False
    best = max((lang for lang in n if lang != own), key=lambda lang: n[lang], default=None)
    return (n[best] if best else 0) + latin >= 2


def defect(question: str | None, answer: str | None) -> tuple[str | None, float]:
    """(defect or None, share of the answer copied from the question)."""
    raw = unicodedata.normalize("NFKC", answer or "")
    text = LABEL.sub("", "".join(c for c in raw if unicodedata.category(c) != "Cf"))
    body = letters(text)
    if not body or re.sub(r"[\s.\-_()*]", "", text.lower()) in NOTHING or body in NOTHING or text.strip().lower() in NOTHING:
        return "empty", 0.0
    asked, copied = letters(LABEL.sub("", question or "")), 0.0
    if asked:
        covered, longest = SuffixAutomaton(asked).walk(body, min(4, len(asked)))
        copied = covered / len(body)
        if copied >= 0.9 and longest >= 0.85 * len(asked):
            return "copy", copied
    given = {m.group() for m in VALUE.finditer(text)} - {m.group() for m in VALUE.finditer(question or "")}
    if not given and next(refusal_automaton().iter(body), None):
        return "refusal", copied
    if is_truncated(text):
        return "truncated", copied
    if asked and in_other_language(question, text):
        return "language", copied
    return None, copied


def _judge(batches):
    for batch in batches:
        found = [defect(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())]
        rows = pa.array([i for i, (d, _) in enumerate(found) if d], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array([d for d, _ in found if d], pa.string()), pa.array([c for d, c in found if d], pa.float64())], ["id", "defect", "copied"])


def defects(items: DataFrame) -> DataFrame:
    """items (id bigint, question, answer) -> (id, defect, copied) of the defective ones; each pair is judged by itself, without a shuffle."""
    rows = items.select(F.col("id").cast("bigint").alias("id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    return rows.mapInArrow(_judge, "id bigint, defect string, copied double")
