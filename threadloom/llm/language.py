"""Missing or wrong language labels (problem 2) by nearest centroids.

Prose is cut into sentences; each becomes a normalised TF-IDF vector of character
n-grams and words and is compared by cosine with several clustered centroids per
language; a sentence near two languages takes the one its item already holds.

Rejection is by distance.  Features that no fitted sentence has count in full as
distance, so words and n-grams of another language take a text away from every
centroid.  Each language has a bound, taken from sentences its centroids weren't
fitted on; the sentences of an item that go to one language are kept if together
they lie within its bound and are written in its letters, else they stay
undetermined.

The centroids start from the seed sentences below and are refitted on sentences
of a bounded sample of labelled documents (SAMPLE_PER_LABEL rows a label) on
which seed and label agree; everything else is classified whole.

Defined results: null, empty and blank texts and texts of code hold no language;
garbled text is restored first; unknown labels state no language; extra columns
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import mojibake

LANGUAGES = ("en", "es", "fr", "de", "pt", "ru", "ja", "zh")
#: Other spellings of the codes and English names of the languages.
_CODES = {
    "en": "en eng english", "es": "es spa spanish castilian", "fr": "fr fra fre french", "de": "de deu ger german",
    "pt": "pt por portuguese", "ru": "ru rus russian", "ja": "ja jpn japanese", "zh": "zh zho chi cmn chinese mandarin",
}
STATED = {w: k for k, v in _CODES.items() for w in v.split()}
SAMPLE_PER_LABEL = 300
CLUSTERS = 10
MAX_FEATURES = 30_000
#: Least cosine of a sentence with the nearest centroid, among known features.
REJECT = 0.08
#: An item's sentences of a language lie within its bound if their mean cosine, unknown features counted, is at least this
#: share of what all but BOUND_QUANTILE of the held-out sentences reach, and never more than BOUND_MOST.  Scripts without
#: spaces, which few languages share, get a wider bound.
BOUND_SHARE, BOUND_QUANTILE, BOUND_MOST, BOUND_CJK = 0.55, 0.03, 0.16, 0.04
#: A text with a larger share of letters that no fitted sentence has is in another language.
FOREIGN_LETTERS = 0.03
#: Cosines closer than this are near each other, of sentences of 40 letters or more and of shorter ones.
NEAR, NEAR_SHORT = 0.03, 0.06
MIN_LETTERS = 20
#: Words count so much more than their n-grams.
WORD_WEIGHT = 2.0
#: Words whose products a worker keeps.
MEMO_WORDS = 50_000
MEMO_SENTENCES = 50_000

_SEED = {
    "en": "The people who live here have been waiting for an answer since the beginning of the week. I would like to know whether you can help us with this. "
    "After the meeting we should look at it again, because nobody was able to explain what happened. Please keep it as it is and tell me which of them you have changed. "
    "This is what they found when it was opened, but only some of the others were there. With these changes it now works on my machine, so I will do it before the demo.",
    "es": "La gente que vive aquí ha estado esperando una respuesta desde el principio de la semana. Me gustaría saber si puedes ayudarnos con esto, por favor. "
    "Después de la reunión tenemos que mirarlo otra vez, porque nadie pudo explicar lo que había pasado. Creo que está mal y que hay que cambiarlo antes de mañana. "
    "Cuando se abrió el archivo, solo estaban algunos de los otros; según lo que vimos, aún no funciona. Ya he podido hacerlo, así que voy a enseñarte cómo queda y qué falta.",
    "fr": "Les gens qui vivent ici attendent une réponse depuis le début de la semaine. Je voudrais savoir si vous pouvez nous aider avec cela, s’il vous plaît. "
    "Après la réunion, il faut le regarder encore une fois, parce que personne n’a pu expliquer ce qui s’est passé. Je pense que c’est cassé et que nous devons le changer avant demain. "
    "Quand on ouvre le fichier, il ne reste que quelques autres ; d’après le journal, cela ne passe pas encore. Je vais le faire et ensuite je te montre le résultat, mais seulement avec les données.",
    "de": "Die Leute, die hier wohnen, warten seit Anfang der Woche auf eine Antwort. Ich möchte wissen, ob du uns dabei helfen kannst, bitte. "
    "Nach der Besprechung müssen wir es noch einmal ansehen, weil niemand erklären konnte, was geschehen ist. Ich glaube, es ist kaputt und wir sollten es vor morgen ändern. "
    "Als die Datei geöffnet wurde, waren nur einige der anderen da; laut dem Protokoll läuft es noch nicht durch. Ich werde das jetzt machen und zeige dir dann das Ergebnis, aber nur für die Daten. "
    "Mein Bruder arbeitet in einem kleinen Laden in der Nähe des Bahnhofs und kommt abends oft spät nach Hause. Gestern haben wir mit unseren Freunden gegessen und über das alte Haus am Meer gesprochen. Es gibt nichts Besseres als ein gutes Buch und eine Tasse Tee, wenn es draußen kalt ist. Sie waren sehr glücklich, weil ihre Kinder alle Prüfungen in der Schule bestanden hatten.",
    "pt": "As pessoas que moram aqui estão esperando uma resposta desde o começo da semana. Eu gostaria de saber se você pode nos ajudar com isso, por favor. "
    "Depois da reunião temos que olhar outra vez, porque ninguém conseguiu explicar o que aconteceu. Acho que está com erro e que precisamos mudar isso antes de amanhã. "
    "Quando o arquivo foi aberto, só estavam alguns dos outros; conforme o registro, ainda não funciona. Já consegui fazer, então vou mostrar como ficou e o que falta, mas só com os dados.",
    "ru": "Люди, которые здесь живут, ждут ответа с начала недели. Я хотел бы знать, можете ли вы нам с этим помочь, пожалуйста. "
    "После встречи нужно посмотреть ещё раз, потому что никто не смог объяснить, что произошло. Я думаю, что это сломано и что мы должны изменить его до завтра. "
    "Когда файл открыли, там были только некоторые из остальных; поэтому счёт пока не сходится. Сейчас я постараюсь сделать это и покажу результат, но только с данными.",
    "ja": "ここに住んでいる人たちは、週の初めから返事を待っています。これについて手伝っていただけるかどうか知りたいです。"
    "会議の後でもう一度見る必要があります。何が起きたのか誰も説明できなかったからです。壊れていると思うので、明日までに変更してください。"
    "ファイルを開いたときには、他のものはほとんどありませんでした。記録によると、まだ失敗しています。これから作業をして、結果をお見せしますが、データだけです。",
    "zh": "住在这里的人从本周初就一直在等答复。我想知道你能不能帮我们处理这件事，谢谢。"
    "会议之后我们需要再看一遍，因为没有人能解释发生了什么。我觉得它坏了，所以明天之前应该修改。"
    "打开文件的时候，只剩下一些其他内容；根据记录，现在还没有通过测试。接下来我会完成这项工作，然后给你看结果，但是只有数据。",
}

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_CODE_LINE = re.compile(
    r"^\s*(?:(?:import|from|const|let|var|def|class|return|function|export|package|using|#include|SELECT|INSERT|UPDATE|DELETE|CREATE|if|for|while|elif|else|try|except|catch)\b.*[{}();=*].*"
    r"|at \S+ \(.*\)|at \S+:\d+.*|\w+ = .*|\d\d:\d\d:\d\d\b.*|sha [0-9a-f]{6,}.*|[0-9a-f]{7,} .*|File \".*|Traceback .*|Caused by.*|(?:WARN|INFO|ERROR|DEBUG|FATAL)\b.*|[{\[].*[}\]],?|<[^>]+>.*</[^>]+>|\$ \w+.*|API Error: \d+|\w+=\S+( \w+=\S+)*)\s*$"
)
#: One mark of a quote or heading, which may also be a prompt; a command behind it, without a run of four plain words.
_QUOTED = re.compile(r"\s*[>#] (?=\w)")
_COMMAND = re.compile(
    r"(?!.*(?: [A-Za-z]+){4})(?!.*[a-z]{2}[.!?]$)(?:sudo )?(?:\S+@\d[\w.-]* \w+"
    r"|(?:git (?:add|branch|checkout|clone|commit|diff|fetch|log|merge|pull|push|rebase|reset|stash|status|switch|tag)|(?:npm|pnpm|yarn|bun) (?:ci|exec|i|install|publish|run|start|test)"
    r"|(?:apt|apt-get|brew|pip3?) (?:install|remove|update|upgrade)|(?:docker|kubectl) (?:apply|build|compose|describe|exec|get|images|logs|ps|pull|push|run)|(?:cargo|go) (?:build|check|fmt|get|install|mod|run|test|vet))(?: .*)?"
    r"|(?!.*(?: [A-Za-z]+){3})(?:awk|bash|cat|cd|chmod|chown|cp|curl|diff|echo|export|find|grep|head|ls|make|mkdir|mv|node|npx|psql|pytest|python3?|rm|rsync|sed|sh|ssh|tail|tar|touch|uv|vitest|wget)(?: .*)?(?: -\S+| \S*[/.=*$|]\w\S*)(?: .*)?"
    r"|(?:cd|ls|pytest|vitest|make)(?: \w+)?)\s*$"
)
_MARK = re.compile(r"^\s*(?:#{1,6}\s+|[-*+>]\s+|\d+[.)]\s+)+")
_MARKUP = re.compile(r"`[^`]*`|https?://\S+|<\|?[\w/|]+\|?>|[\w.+-]+@[\w.-]+|[\w.+-]+ ?[\[(]at[\])] ?[\w.\[\]()-]+|[\w+-]+(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+")
#: ASCII words with a digit, an inner capital, underscore, slash or dot: paths, identifiers, numbers, tickets.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]*(?:[_/\\$\d]|\.(?=[A-Za-z0-9_])|-(?=\d)|(?<=[a-z0-9])[A-Z]|\(\))[A-Za-z0-9_/\\$.\-]*(?:\(\))?")
_MARKS = frozenset(" \t#-*+>0123456789")
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\bSt\.)(?<!str\.)(?<!\bDr\.)(?<!\b[A-Z]\.)\s+|(?<=[。！？])|\n+")
_LATIN_RUN = r"A-Za-zÀ-ɏḀ-ỿ"
_CYRILLIC_RUN = r"Ѐ-ӿ"
_CJK_RUN = r"぀-ヿ㐀-鿿ｦ-ﾝ々"
_SCRIPT = re.compile(
    f"[{_LATIN_RUN}][^{_CYRILLIC_RUN}{_CJK_RUN}]*|[{_CYRILLIC_RUN}][^{_LATIN_RUN}{_CJK_RUN}]*|[{_CJK_RUN}][^{_LATIN_RUN}{_CYRILLIC_RUN}]*"
)
_MARKED = re.compile(r"[`<@]|://|[\[(]at[\])]| dot ")
_CJK = re.compile(f"[{_CJK_RUN}ー]+")
_SPACES = re.compile(r"[\W\d_]+")


def stated_language(label: str | None) -> str:
    """The language a label states, '' if none."""
    word = re.split(r"[-_\s.]", (label or "").strip().lower())[0]
    return STATED.get(word, "")


def _is_code(line: str) -> bool:
    """Whether a line is code; a quote or heading only if what stands behind its mark is code or a command."""
    if _CODE_LINE.match(line):
        return True
    mark = _QUOTED.match(line)
    return bool(mark) and bool(_COMMAND.match(line[mark.end() :]) or _CODE_LINE.match(line[mark.end() :]))


def prose_sentences(text: str) -> Iterator[str]:
    """The sentences of a text without code, traces, paths and identifiers; parts in another script stand by themselves."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    for line in text.splitlines():
        if not line or _is_code(line):
            continue
        if line[0] in _MARKS:
            line = _MARK.sub("", line)
        parts = _SENTENCE.split(line)
        for s in parts:
            if not s or len(parts) > 1 and _is_code(s):
                continue
            if _MARKED.search(s):
                s = _MARKUP.sub(" ", s)
            s = _IDENTIFIER.sub(" ", s)
            if s.isascii():
                yield s
            else:
                yield from (m[0] for m in _SCRIPT.finditer(s))


def normalised(sentence: str) -> str:
    return _SPACES.sub(" ", sentence.lower().replace("�", "")).strip()


def pieces(s: str) -> list[str]:
    """What a normalised sentence is made of: words, and for scripts without spaces every pair of characters."""
    if s.isascii() or not _CJK.search(s):
        return s.split()
    out = []
    for w in s.split():
        if _CJK.fullmatch(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        else:
            out.append(w)
    return out


def grams(piece: str) -> list[str]:
    """A word's character n-grams (n = 1 to 4, with its ends marked) and the word; a pair's characters and the pair."""
    if _CJK.fullmatch(piece):
        return [piece[0], piece]
    padded = f" {piece} "
    out = [padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)]
    return [g for g in out if g != " "] + ["\x02" + piece]


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


_memos: dict[int, tuple[dict, dict]] = {}


class Centroids:
    """TF-IDF weights and unit centroids, several per language."""

    def __init__(self, index: dict[str, int], idf: np.ndarray, centroids: np.ndarray, owner: list[str], unknown: float, bounds: dict[str, float] | None = None):
        self.index, self.idf, self.centroids, self.owner, self.unknown = index, idf, centroids.astype(np.float32), owner, unknown
        self.bounds = bounds or {}
        self.by_feature = np.ascontiguousarray(self.centroids.T)
        self.held = sorted(set(owner), key=owner.index)
        self.starts = np.array([owner.index(k) for k in self.held])
        self.slots = [LANGUAGES.index(k) for k in self.held]
        self.words: dict[str, tuple[np.ndarray, np.ndarray, float, int]]
        self.sentences: dict[str, tuple[float, ...]]
        # What a worker has learnt in one task serves the next ones of the same model.
        mark = zlib.crc32(self.centroids.tobytes())
        if mark not in _memos:
            _memos.clear()
            _memos[mark] = ({}, {})
        self.words, self.sentences = _memos[mark]

    def __getstate__(self):
        return self.index, self.idf, self.centroids, self.owner, self.unknown, self.bounds

    def __setstate__(self, state):
        self.__init__(*state)

    @staticmethod
    def fit(samples: list[tuple[str, str]], clusters: int = CLUSTERS, rounds: int = 12, bounded: bool = True) -> Centroids:
        """samples: (language, normalised sentence); bounds come from every other sentence, by centroids of the rest."""
        bounds = {}
        if bounded:
            part = Centroids.fit(samples[::2], clusters, rounds, False)
            for lang in LANGUAGES:
                own = [n for k, n in samples[1::2] if k == lang]
                near = sorted(part.fitness(x) for n, x in zip(own, part.similarities(own)) if x[LANGUAGES.index(lang)] == max(x[: len(LANGUAGES)]))
                low = near[int(len(near) * BOUND_QUANTILE)] if len(near) >= 20 else 1.0
                bounds[lang] = min(BOUND_CJK if lang in ("ja", "zh") else BOUND_MOST, BOUND_SHARE * low) if near else 0.0
            del part
        counts = [Counter(g for w in pieces(s) for g in grams(w)) for _, s in samples]
        df = Counter(g for c in counts for g in c)
        top = sorted(df.items(), key=lambda x: (-x[1], x[0]))[:MAX_FEATURES]
        index = {g: i for i, (g, _) in enumerate(top)}
        idf = np.array([WORD_WEIGHT if g[0] == "\x02" else 1.0 for g, _ in top]) * np.log((1 + len(samples)) / (1 + np.array([n for _, n in top], dtype=float))) + 0.3
        x = np.zeros((len(samples), len(index)), dtype=np.float32)
        for i, c in enumerate(counts):
            for g, n in c.items():
                if (j := index.get(g)) is not None:
                    x[i, j] = n * idf[j]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        cents, owner = [], []
        labels = np.array([k for k, _ in samples])
        for lang in LANGUAGES:
            own = x[labels == lang]
            if not len(own):
                continue
            k = min(clusters, max(1, len(own) // 8))
            at = own[[0]]
            while len(at) < k:  # farthest first, then spherical k-means
                at = np.vstack([at, own[np.argmin((own @ at.T).max(1))]])
            for _ in range(rounds):
                near = np.argmax(own @ at.T, 1)
                at = np.vstack([own[near == j].sum(0) if (near == j).any() else at[j] for j in range(k)])
                at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
            cents.append(at)
            owner += [lang] * k
        return Centroids(index, idf.astype(np.float32), np.vstack(cents), owner, float(np.log((1 + len(samples)) / 2) + 0.3), bounds)

    def _word(self, w: str) -> tuple[np.ndarray, np.ndarray, float, int]:
        """(feature ids, their part of the product with every centroid, squared weight of unknown features, unknown letters) of a word."""
        own = grams(w)
        get = self.index.get
        ids = [j for g in own if (j := get(g)) is not None]
        beyond, letters = 0.0, 0
        if len(ids) < len(own):
            away = [g for g in own if g not in self.index]
            beyond = self.unknown**2 * sum(WORD_WEIGHT**2 if g[0] == "\x02" else 1 for g in away)
            letters = sum(len(g) == 1 and not _CJK.match(g) for g in away)
        ids = np.array(ids, dtype=np.int64)
        hit = ids, self.idf[ids] @ self.by_feature[ids] if len(ids) else np.zeros(len(self.owner), np.float32), beyond, letters
        if len(self.words) < MEMO_WORDS:
            self.words[w] = hit
        return hit

    def similarities(self, sentences: list[str]) -> list[tuple[float, ...]]:
        """For each normalised sentence its cosine with the nearest centroid of each language, in the order of LANGUAGES,
        then the factor that unknown features shorten cosines by, and the number of unknown letters.

        A sentence's product with a centroid is the sum of its words' products;
        its length comes from the summed weights of its features.
        """
        none, fresh = (0.0,) * (len(LANGUAGES) + 2), {}
        out = [self.sentences.get(s) for s in sentences]
        todo = list(dict.fromkeys(s for s, x in zip(sentences, out) if x is None))
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            known = [[self.words.get(w) or self._word(w) for w in pieces(s)] for s in part]
            flat = [k for ks in known for k in ks]
            n_ids = np.array([sum(len(k[0]) for k in ks) for ks in known])
            if not n_ids.sum():
                fresh.update(dict.fromkeys(part, none))
                continue
            ids = np.concatenate([k[0] for k in flat]) + np.repeat(np.arange(len(part)) * len(self.idf), n_ids)
            ids.sort()
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            weight = np.diff(np.r_[first, len(ids)]) * self.idf[ids[first] % len(self.idf)]
            norm = np.sqrt(np.bincount(ids[first] // len(self.idf), weight * weight, len(part)))
            n_words = [len(ks) for ks in known]
            held = [i for i, n in enumerate(n_words) if n]
            starts = np.cumsum([0, *n_words])[held]
            dots = np.add.reduceat(np.array([k[1] for k in flat]), starts, axis=0)
            best = np.maximum.reduceat(dots, self.starts, axis=1) / np.maximum(norm[held], 1e-9)[:, None]
            rows = np.zeros((len(part), len(LANGUAGES) + 2))
            rows[np.ix_(held, self.slots)] = best
            beyond, letters = np.add.reduceat(np.array([k[2:] for k in flat]), starts, axis=0).T
            rows[held, -2] = norm[held] / np.maximum(np.sqrt(norm[held] ** 2 + beyond), 1e-9)
            rows[held, -1] = letters
            fresh.update(zip(part, map(tuple, rows.tolist())))
        if len(self.sentences) < MEMO_SENTENCES:
            self.sentences.update(fresh)
        return [x if x is not None else fresh[s] for s, x in zip(sentences, out)]

    def similarity(self, s: str) -> tuple[float, ...]:
        return self.similarities([s])[0][: len(LANGUAGES)]

    @staticmethod
    def fitness(row: tuple[float, ...], best: int | None = None) -> float:
        """Cosine with the nearest centroid (of one language), unknown features counted."""
        return (max(row[: len(LANGUAGES)]) if best is None else row[best]) * row[-2]

    def within(self, lang: str, fit: float, letters: int, foreign: int) -> bool:
        """Whether sentences of so many letters, at this letter-weighted sum of cosines, belong to a language."""
        return fit >= self.bounds.get(lang, 0.0) * letters and foreign <= FOREIGN_LETTERS * letters


def classified_all(texts: list[str | None], labels: list[str | None], model: Centroids) -> Iterator[list[tuple[str, float, int, str]]]:
    """(language or '', confidence, letters, text) of the sentences of each item.

    A sentence near several languages takes the one the item holds most of
    otherwise, then the one its label states.
    """
    cut = []
    for text in texts:
        rows = [(s, normalised(s)) for s in prose_sentences(mojibake.repair(text)[0])] if text else []
        cut.append([(s, n) for s, n in rows if n])
    sims = iter(model.similarities([n for rows in cut for _, n in rows]))
    for rows, label in zip(cut, labels):
        scored, held = [], [0] * len(LANGUAGES)
        for s, n in rows:
            row, letters = next(sims), len(n) - n.count(" ")
            sim = row[: len(LANGUAGES)]
            second, first = sorted(sim)[-2:]
            gap = NEAR if letters >= 40 else NEAR_SHORT
            scored.append((s, letters, sim, first, gap, row))
            if first >= REJECT and first - second >= gap:
                held[sim.index(first)] += letters
        stated = stated_language(label)
        known = LANGUAGES.index(stated) if stated else -1
        out = []
        sums: dict[str, list] = {}
        for s, letters, sim, first, gap, row in scored:
            if first < REJECT:
                out.append(("", 0.0, letters, s))
                continue
            near = [j for j, x in enumerate(sim) if first - x < gap]
            best = near[0] if len(near) == 1 else max(near, key=lambda j: (held[j], j == known, sim[j]))
            rest = max(x for j, x in enumerate(sim) if j != best)
            out.append((LANGUAGES[best], min(1.0, max(0.0, 0.5 + (sim[best] - rest) / (2 * sim[best]))), letters, s))
            pooled = sums.setdefault(LANGUAGES[best], [0.0, 0, 0])
            pooled[0] += sim[best] * row[-2] * letters
            pooled[1] += letters
            pooled[2] += int(row[-1])
        gone = {k for k, v in sums.items() if not model.within(k, *v)}
        yield [("", 0.0, *x[2:]) if x[0] in gone else x for x in out] if gone else out


def joined_segments(sentences: list[tuple[str, float, int, str]]) -> list[tuple[str, float, int, str]]:
    """Neighbouring sentences of one language as one segment."""
    out = []
    for lang, group in groupby(sentences, key=lambda x: x[0]):
        group = list(group)
        n = sum(g[2] for g in group)
        out.append((lang, sum(g[1] * g[2] for g in group) / n, n, " ".join(g[3].strip() for g in group)))
    return out


def segments(text: str | None, model: Centroids, label: str | None = None) -> list[tuple[str, float, int, str]]:
    """(language or '', confidence, letters, text) of the parts of one item."""
    return joined_segments(next(classified_all([text], [label], model)))


def seed_model() -> Centroids:
    """Centroids of the seed sentences, with and without accents."""
    rows = [(k, normalised(s)) for k, v in _SEED.items() for s in prose_sentences(v) if s.strip()]
    rows += [(k, _plain(s)) for k, s in rows if k in ("es", "fr", "de", "pt")]
    return Centroids.fit(rows, clusters=1, bounded=False)


def fit(labelled: DataFrame, per_label: int = SAMPLE_PER_LABEL, key: str = "doc_id") -> Centroids:
    """labelled(doc_id, text, lang): centroids refitted on a bounded sample, per_label rows of each language.

    The rows with the least hashes are taken, so the sample doesn't depend on
    order or partitions; only their ids are ranked.
    """
    stated = F.lower(F.split(F.trim("lang"), r"[-_\s.]")[0])
    codes = F.create_map(*(F.lit(x) for kv in sorted(STATED.items()) for x in kv))
    narrow = labelled.select(key, codes[stated].alias("code"), F.xxhash64(key).alias("h"), F.length("text").alias("n")).where("code is not null and n between 20 and 4000")
    ids = narrow.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", key))).where(F.col("r") <= per_label).select(key).collect()
    seed = seed_model()
    rows = [(k, s) for k, v in _SEED.items() for s in map(normalised, prose_sentences(v)) if s]
    if ids:
        sample = labelled.where(F.col(key).isin([r[0] for r in ids])).select("lang", "text").collect()
        seen: dict[tuple[str, str], None] = {}
        for label, text in sorted((r["lang"] or "", r["text"] or "") for r in sample):
            lang = stated_language(label)
            if not text.isascii():
                text = mojibake.repair(text)[0]
            for s in prose_sentences(text):
                n = normalised(s)
                if len(n) >= (20 if n.isascii() or not _CJK.search(n) else 8):
                    sim = seed.similarity(n)
                    if LANGUAGES[int(np.argmax(sim))] == lang:
                        seen.setdefault((lang, n))
        per: dict[str, int] = Counter()
        for lang, n in seen:  # a fixed number of sentences a language
            if per[lang] < per_label:
                per[lang] += 1
                rows.append((lang, n))
    rows += [(k, _plain(s)) for k, s in rows if k in ("es", "fr", "de", "pt") and _plain(s) != s]
    # Sentences are spread by their hashes, so that halves of them are alike.
    return Centroids.fit(sorted(rows, key=lambda r: (zlib.crc32(r[1].encode()), r)))


def _joined(items: DataFrame) -> DataFrame:
    return items.select("src", "item_id", "label", F.array_join("texts", "\n\n").alias("text"))


def item_segments(items: DataFrame, model: Centroids) -> DataFrame:
    """items(src, item_id, label, texts) -> one row per segment: (src, item_id, label, segment_no, lang, confidence, letters, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            found = classified_all(pdf.text.tolist(), pdf.label.tolist(), model)
            for src, i, label, sentences in zip(pdf.src, pdf.item_id, pdf.label, found):
                rows += [(src, i, label, n, *x) for n, x in enumerate(joined_segments(sentences))]
            yield pd.DataFrame(rows, columns=["src", "item_id", "label", "segment_no", "lang", "confidence", "letters", "text"])

    return _joined(items).mapInPandas(
        run, "src string, item_id long, label string, segment_no int, lang string, confidence double, letters int, text string"
    )


_HELD = pa.schema([("src", pa.string()), ("item_id", pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("letters", pa.int32()), ("confidence", pa.float64())])


def held_languages(items: DataFrame, model: Centroids, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(src, item_id, label, lang, letters, confidence): the languages an item holds, with at least min_letters letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            srcs, ids, labels, texts = (c.to_pylist() for c in b.columns)
            for src, i, label, sentences in zip(srcs, ids, labels, classified_all(texts, labels, model)):
                n: dict[str, int] = defaultdict(int)
                c: dict[str, float] = defaultdict(float)
                for lang, conf, letters, _ in sentences:
                    if lang:
                        n[lang] += letters
                        c[lang] += conf * letters
                rows += [(src, i, label, k, n[k], c[k] / n[k]) for k in n if n[k] >= min_letters]
            columns = list(zip(*rows)) or [()] * len(_HELD)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HELD)], schema=_HELD)

    # A character stands for two letters at most, even where a wrong decoding has to be undone.
    return _joined(items).where(F.length("text") * 2 >= min_letters).mapInArrow(run, "src string, item_id long, label string, lang string, letters int, confidence double")


def unstated(held: DataFrame) -> DataFrame:
    """(src, item_id, lang): the languages items hold and their labels don't state."""
    codes = F.create_map(*(F.lit(x) for kv in sorted(STATED.items()) for x in kv))
    stated = codes[F.lower(F.split(F.regexp_replace(F.coalesce("label", F.lit("")), r"(?U)^\s+|\s+$", ""), r"[-_\s.]")[0])]
    return held.where(F.coalesce(stated, F.lit("")) != F.col("lang")).select("src", "item_id", "lang")


def items_of(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents and records as items: (src, item_id, label, texts)."""
    texts = F.expr("transform(filter(message.content, b -> b.type = 'text'), b -> b.text)")
    return documents.select(F.lit("documents").alias("src"), F.col("doc_id").alias("item_id"), F.col("lang").alias("label"), F.array("text").alias("texts")).unionByName(
        records.select(F.lit("records").alias("src"), F.col("rec_id").alias("item_id"), F.col("lang").alias("label"), texts.alias("texts"))
    ).where("size(texts) > 0")
