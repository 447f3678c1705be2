"""p3: languages of notes and of their lines, by naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.terms import sliced
from marginalia.operators.corpus import notes_once

#: The languages, with the codes and names that labels give them.
LABELS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français",
    "es": "es spa spanish español castellano",
    "pt": "pt por portuguese português",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese cmn 中文",
}
LANGUAGES = tuple(LABELS)
#: What a text is in that is like none of these languages.
UNKNOWN = "und"
#: Common words of each language, from which the model starts where no labelled note tells more.
SEEDS = {
    "en": "the of and to in is that it was for on are with as his they be at this have from or had by but what some we can out other were all there when up use your how said each she which their time will way about many then them would like so these her long make thing see him two has look more day could go come did my sound no most who over know water than call first people may down side been now find any new work part take get place made live where after back little only round man year came show every good me give our under",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle diesem seit muss wurden beim doch jetzt waren drei jedoch haus zeit straße heute weil ihm",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ils mais comme on tout nous sa même ou si leur être deux cette ont aux ses elle bien après fait encore aussi peu très sans sous entre toujours jour année avant faire temps depuis dont où été autres même tous autre lui avait chez donc alors quand peut notre était leurs première trois vie ainsi moins rien selon vous je mon homme ces pendant quelques maison grand contre cela trop",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos mundo año antes estado contra sino forma caso nada hacer",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse dele tu te vocês vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo estou ano vez dia",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об другой",
    "zh": "的 一 是 不 了 在 人 有 我 他 这 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你 对 生 能 而 子 那 得 于 着 下 自己 之 年 过 发 后 作 里 用 道 行 所 然 家 种 事 成 方 多 经 么 去 法 学 如 都 同 现 当 没有 动 面 起 看 定 天 分 还 进 好 小 部 其 些 主 样 理 心 她 本 前 开 但 因为 只 从 想 实 我们 他们 因此 所以 可以 什么",
}
ORDERS = (1, 2, 3, 4)
BITS = 17
BUCKETS = 1 << BITS

#: What has no language: inline code, formulas, comments, tags, links' targets, addresses and paths.
INLINE = re.compile(
    r"""^\s*(?:\{\||\|-|\|\}).*$ | ^\s*\[[^\]\n]+\]:.*$ | ^(?:\s*>)+\s*\[![\w-]+\][+-]? | `+[^`\n]*`+ | \$\$[^$\n]*\$\$ | (?<![\w$])\$[^\s$][^$\n]*\$(?!\w)
    | \\\([^\n]*?\\\) | \\\[[^\n]*?\\\] | \\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})* | <!--.*?--> | </?[A-Za-z][^<>\n]*> | &(?:\#\d+|\#x[0-9a-fA-F]+|[A-Za-z]+);
    | \]\([^()\n]*\) | \[\[[^\[\]|\n]*\| | \{\{[^{}\n]*\}\} | (?<!\S)\w+://\S+ | (?<!\S)[\w.+-]+@\S+ | (?<!\S)[\w.:-]*[\\/]\S*[\\/]\S* | \b[^\W_]+_\w+""",
    re.VERBOSE,
)
#: Lines without any of these signs hold nothing of the kind; encoded data is a long run of letters, digits and signs.
SIGNS = re.compile(r"[`$\\<&\[\]{}|@/_]")
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{25,}")
FENCE = re.compile(r"^\s{0,3}(?:[>*+-]\s+)*(`{3,}|~{3,})")
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
WORD = re.compile(r"[^\W\d_\u3400-\u9fff]{2,}")


def language_of(label: Column) -> Column:
    """The language that a label names, whatever its spelling or region; null if it names none of them."""
    first = F.lower(F.regexp_extract(F.trim(label), r"(?U)^(\p{L}+)", 1))
    out = F.lit(None).cast("string")
    for code, names in LABELS.items():
        out = F.when(first.isin(*names.split()), code).otherwise(out)
    return out


def spoken_lines(text: str) -> list[str]:
    """The lines of a text with all that has no language blanked out; their number stays.

    Full-width letters become ordinary ones and invisible characters go. A sign that opens a block
    is ordinary text if no later line closes it.
    """
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    lines, fence, block = text.split("\n"), "", ""
    lasts: dict[str, int] = {}
    for k, line in enumerate(lines):
        mark = FENCE.match(line)
        if fence:
            if mark and mark.group(1).startswith(fence) and not line[mark.end() :].strip("`~ \r\t"):
                fence = ""
            lines[k] = ""
        elif block:
            block = "" if block in line else block
            lines[k] = ""
        elif mark:
            fence, lines[k] = mark.group(1), ""
        else:
            for start, end in (("$$", "$$"), ("\\[", "\\]"), ("\\begin{", "\\end{"), ("<pre", "</pre"), ("<!--", "-->"), ("%%", "%%")):
                a = line.find(start)
                if a >= 0 and end not in line[a + len(start) :]:
                    if end not in lasts:  # of lines yet to be read, so none is blanked already
                        lasts[end] = next((n for n in range(len(lines) - 1, k, -1) if end in lines[n]), -1)
                    if lasts[end] > k:
                        block, line = end, line[:a]
                        break
            if SIGNS.search(line):
                line = INLINE.sub(" ", line)
            lines[k] = ENCODED.sub(" ", line)
    return lines


@cache
def _alphabet() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(n).isalpha() for n in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(lines: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Hashed character n-grams with their lines, by order; letters and Han characters per line.

    Case, digits and signs don't count: every run of others than letters is one blank. Han
    characters count as letters.
    """
    codes = np.frombuffer("\n".join(lines).lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    new_line = codes == 10
    line = np.cumsum(new_line) - new_line
    letter = _alphabet()[codes]
    per_line = np.bincount(line[letter], minlength=len(lines))
    han = np.bincount(line[(codes >= 0x3400) & (codes <= 0x9FFF)], minlength=len(lines))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]
    c = np.where(letter, codes, 32).astype(np.uint32)[keep]
    own, blank = line[keep], ~letter[keep]
    out, h = [], c
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        if n > 1:
            h = (h[:m] * np.uint32(0x01000193)) ^ c[n - 1 :]
        if n in ORDERS:
            same = ~blank if n == 1 else own[:m] == own[n - 1 :]
            mixed = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            out.append(((mixed >> np.uint32(32 - BITS))[same].astype(np.int64), own[:m][same]))
    return out, per_line, han


class Model:
    """Log probabilities of the hashed n-grams in each language, and the usual score of a letter in each."""

    def __init__(self, counts: np.ndarray, smoothing: float = 0.05):
        total = counts.sum(axis=0, keepdims=True)
        self.logs = np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32)
        self.usual = np.full(len(LANGUAGES), -np.inf)

    def scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log probabilities of each line in each language, its letters and Han characters."""
        by_order, letters, han = grams(lines)
        out = np.zeros((len(lines), len(LANGUAGES)))
        for g, at in by_order:
            if len(g):
                starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                out[at[starts]] += np.add.reduceat(self.logs[g], starts, axis=0)
        return out, letters, han

    def unlike(self, sums: np.ndarray, letters: int) -> bool:
        """Whether a text of so many letters with these sums is like none of the languages.

        It is if a letter of it scores far below what letters of the best language do in the
        sample, or clearly below and hardly better than in the second.
        """
        if letters < LEAST_LETTERS:
            return False
        best = int(sums.argmax())
        second = np.partition(sums, -2)[-2]
        below = self.usual[best] - sums[best] / letters
        return bool(below > FAR or below > BELOW and (sums[best] - second) / letters < CLEAR)


#: When a text is like no language: its least letters, and the nats a letter below the usual score, and above the second language.
LEAST_LETTERS, FAR, BELOW, CLEAR = 40, 20.0, 5.0, 1.5


def _count_lines(rows: list[tuple[str, int]], model: Model | None) -> np.ndarray:
    """N-gram counts by language of labelled texts, line by line.

    With a model of an earlier round, a line counts for the language that the model gives it, so
    wrong labels and foreign lines of the sample don't spoil the next one.
    """
    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    for text, label in rows:
        lines = spoken_lines(text)
        best = np.full(len(lines), label) if model is None else model.scores(lines)[0].argmax(axis=1)
        for g, at in grams(lines)[0]:
            np.add.at(counts, (g, best[at]), 1.0)
    return counts


def _seeds(absent: list[int]) -> np.ndarray:
    """N-gram counts of the common words of the languages that no sampled note is labelled with."""
    rows = [("\n".join(SEEDS[LANGUAGES[k]].split() if LANGUAGES[k] == "zh" else [SEEDS[LANGUAGES[k]]]), k) for k in absent]
    return _count_lines(rows, None) if rows else np.zeros((BUCKETS, len(LANGUAGES)))


def train(notes: DataFrame, per_language: int = 150, rounds: int = 3) -> Model:
    """The classifier, fitted on a bounded sample of notes.

    ``per_language`` is the bound: so many notes of each label, first in the order of a hash of
    their id, with their whole contents. Labels may be wrong; ``rounds`` of refitting on the lines'
    own languages cure that. If a language has no labelled note, labels aren't trusted at all: the
    model starts from the built-in lists of common words, and as many notes without label are
    sampled too, so that a collection without labels is fitted as well.
    """
    labelled = notes.where((F.length("content") > 100) & F.col("note_id").isNotNull()).select("note_id", "content", F.coalesce(language_of(F.col("lang")), F.lit(UNKNOWN)).alias("label"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("note_id"), "note_id")
    ranked = labelled.select("note_id", "label").withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= 2 * per_language)
    chosen: dict[str, dict[int, None]] = {}
    for r in ranked.orderBy("label", "__rank").collect():  # at most twice the bound, as rows may come again
        own = chosen.setdefault(r["label"], {})
        if len(own) < per_language:
            own[r["note_id"]] = None
    absent = [k for k, c in enumerate(LANGUAGES) if c not in chosen]
    if not absent:
        chosen.pop(UNKNOWN, None)
    ids = sorted({i for own in chosen.values() for i in own})
    rows = labelled.where(F.col("note_id").isin(ids)).dropDuplicates(["note_id"]).select("content", "label").collect()
    data = [(r["content"], LANGUAGES.index(r["label"])) for r in rows if r["label"] != UNKNOWN]
    free = [(r["content"], -1) for r in rows if r["label"] == UNKNOWN]
    seeds = _seeds(absent)
    model = Model(_seeds(list(range(len(LANGUAGES)))) if absent else _count_lines(data, None))
    for _ in range(rounds if absent else rounds - 1):
        model = Model(_count_lines(data + free, model) + seeds)
    scored = [(sums, letters.sum()) for text, _ in data + free for each, letters, _ in [model.scores(spoken_lines(text))] for sums in [each.sum(axis=0)] if letters.sum()]
    if scored and not absent:  # else the scores are those of too few texts to say what is usual
        best = np.array([int(sums.argmax()) for sums, _ in scored])
        per_letter = np.array([sums.max() / letters for sums, letters in scored])
        model.usual = np.array([per_letter[best == k].mean() if (best == k).any() else -np.inf for k in range(len(LANGUAGES))])
    return model


def judge(text: str, model: Model, least: int, sure: float) -> list[tuple[int, str, float]]:
    """``(row_no, language, confidence)`` of a text (row -1) and of its foreign lines.

    The text's language is that with most letters over its lines (a Han character counts as three).
    Its confidence is the probability that a letter of it is in that language: the lines' posteriors,
    weighted by their letters; the orders of n-grams tell the same letters again, so the posteriors
    are tempered by their number. A text like none of the languages is ``und``. A line is foreign if
    another language beats the text's by ``sure`` nats a letter and it has ``least`` words, or Han
    characters for Chinese; its confidence is its posterior.
    """
    lines = spoken_lines(text)
    return _judge(lines, *model.scores(lines), model, least, sure)


def _judge(lines: list[str], scores: np.ndarray, letters: np.ndarray, han: np.ndarray, model: Model, least: int, sure: float) -> list[tuple[int, str, float]]:
    weight = letters + 2 * han
    if not weight.sum():
        return []
    best = scores.argmax(axis=1)
    shares = np.bincount(best, weights=weight, minlength=len(LANGUAGES))
    main = int(shares.argmax())
    p = np.exp((scores - scores.max(axis=1, keepdims=True)) / len(ORDERS))
    p /= p.sum(axis=1, keepdims=True)
    unknown = model.unlike(scores.sum(axis=0), int(letters.sum()))
    out = [(-1, UNKNOWN if unknown else LANGUAGES[main], float((p[:, main] * weight).sum() / weight.sum()))]
    margin = scores.max(axis=1) - scores[:, main]
    for k in np.flatnonzero((best != main) & (margin >= sure * np.maximum(letters, 5)) & (letters > 0)).tolist():
        if (han[k] if LANGUAGES[int(best[k])] == "zh" else len(WORD.findall(lines[k]))) < least:
            continue
        out.append((k, UNKNOWN if model.unlike(scores[k], int(letters[k])) else LANGUAGES[int(best[k])], float(p[k].max())))
    return out


#: Characters of texts whose lines are scored in one array.
AT_ONCE = 1 << 18


def judge_all(texts: list[str], model: Model, least: int, sure: float) -> Iterator[list[tuple[int, str, float]]]:
    """The same for many texts; short ones share arrays."""
    held: list[list[str]] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(spoken_lines(text))
        size += len(text)
        if size >= AT_ONCE or k == len(texts) - 1:
            scores, letters, han = model.scores([x for lines in held for x in lines])
            at = 0
            for lines in held:
                part = slice(at, at + len(lines))
                yield _judge(lines, scores[part], letters[part], han[part], model, least, sure)
                at += len(lines)
            held, size = [], 0


def _run(shared: object, least: int, sure: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "content"):
            judged = judge_all(batch.column("content").to_pylist(), shared.value, least, sure)
            out = [(i, label, *r) for i, label, found in zip(batch.column("note_id").to_pylist(), batch.column("label").to_pylist(), judged, strict=True) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64()))], ["note_id", "label", "row_no", "lang", "confidence"])

    return run


def languages(notes: DataFrame, least: int = 3, sure: float = 3.0, per_language: int = 150) -> DataFrame:
    """``(note_id, label, row_no, lang, confidence)``: each note's language, and its foreign lines'.

    ``label`` is the language that the delivered label names, null if none. ``row_no`` is -1 for the
    note, else the line's number from 0. The model is sent to all tasks; its size is fixed. Notes
    without letters outside code and formulas have no row; of repeated rows of a note the one indexed
    first counts; rows without an id are notes of their own.
    """
    model = train(notes, per_language)
    shared = notes.sparkSession.sparkContext.broadcast(model)
    own = notes_once(notes.select("note_id", "indexed_at", "content", "lang")).where(F.length("content") > 0).select("note_id", "content", language_of(F.col("lang")).alias("label"))
    return own.mapInArrow(_run(shared, least, sure), "note_id bigint, label string, row_no int, lang string, confidence double")


def found(notes: DataFrame) -> DataFrame:
    """p3_found: notes with a missing or wrong label, and lines in another language than their note."""
    other = "row_no >= 0 or label is null or label <> lang"
    return languages(notes).where(f"lang <> '{UNKNOWN}' and ({other})").select("note_id", "row_no", "lang")
