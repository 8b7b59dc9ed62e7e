"""Languages of documents and of their lines: interpolated Kneser-Ney character models, chosen by cross-entropy.

A model of each language (and script) predicts every character of a word, and its end, from up to ORDER - 1 characters
before. The discounted probabilities of all n-grams and the back-off weights of all contexts lie in arrays sorted by hash.
A word's bits don't depend on its neighbours, so each distinct word is scored once per task; lines and sentences add up the
bits of their words. A sentence takes another language than its line only if that saves STAY bits; the line has the language
of most of its words. Confidence is the posterior under a temperature fitted on held-out lines; a line is rejected if its
confidence is under LEAST_CONFIDENCE, or if its bits per character are beyond what held-out lines of the language need.

The models are fitted on a bounded sample: about SAMPLE different labelled texts of each language and script, the ones with the
smallest hash. Labels may be wrong and documents mixed: lines are relabelled by a first fit before the second one. A script is
modelled from LEAST_WORDS words of LEAST_DOCS documents on (a language's main script from one), whatever its share, unless
another language explains its lines.

A line that changes language is several segments, runs of sentences with one language each (``language_of_segments``).

Defined results: null and empty contents have no lines, and such documents, like those all of whose lines are rejected, have no language, with a confidence of 0; a line without words with letters has no language; repeated rows of an
id count once, rows without an id not at all; labels that name no supported language train nothing. Without any usable label there is no model and no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.text_arrays import Words, chunks, mix, words

ORDER, SAMPLE, ROUNDS, STAY, LEAST_CONFIDENCE = 5, 400, 2, 10.0, 0.5
LEAST_WORDS, LEAST_DOCS, MUCH_BETTER = 100, 3, 0.85
# How labels name each language, by English or own name or ISO code.
LABELS = {
    "english": "english en eng",
    "serbian": "serbian srpski српски sr srp",
    "german": "german deutsch de deu ger",
    "french": "french français francais fr fra fre",
    "spanish": "spanish español espanol castellano es spa",
}
LINES = "id string, label string, line_no int, words int, language string, confidence double, bits double"
SEGMENTS = "id string, line_no int, begin int, length int, words int, language string, confidence double"
_START, _END, _SPREAD = 1, 2, np.uint64(0x9E3779B97F4A7C15)
_STOPS = np.array([ord(c) for c in ".!?…"], np.uint32)


def named_language(label: Column) -> Column:
    """The language that a label names, in any case and with or without a suffix; null if none."""
    stem = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)", 1))
    out = F.lit(None).cast("string")
    for language, names in LABELS.items():
        out = F.when(stem.isin(*names.split()), language).otherwise(out)
    return F.when(label.isNull(), None).otherwise(out)


@dataclass
class Letters:
    """Words as one array of characters with start and end marks, and the hashes of all n-grams that end at each place."""

    word: np.ndarray
    depth: np.ndarray
    grams: list[np.ndarray]
    chars: np.ndarray
    looked_up: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)

    def lookups(self, k: int) -> tuple[np.ndarray, ...]:
        """The places that an n-gram of k characters predicts; the different n-grams and contexts there, in order, and which is where: the same for every model."""
        if k not in self.looked_up:
            place = np.flatnonzero((self.depth > 0) & (self.depth >= k - 1))
            self.looked_up[k] = (place, *np.unique(self.grams[k - 1][place], return_inverse=True), *np.unique(_context(self, k - 1)[place], return_inverse=True))
        return self.looked_up[k]


def letters(w: Words, which: np.ndarray) -> Letters:
    size = (w.end - w.start)[which] + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(which)), size)
    depth = np.arange(len(word)) - first[word]
    chars = np.full(len(word), _START, np.uint64)
    inner = (depth > 0) & (depth < size[word] - 1)
    chars[inner] = w.codes[(w.start[which][word] + depth - 1)[inner]]
    chars[first + size - 1] = _END
    h, grams = np.zeros(len(word), np.uint64), []
    for k in range(ORDER):
        h = h + mix(np.roll(chars, k) * _SPREAD + np.uint64(k + 1))
        grams.append(h)
    return Letters(word, depth, grams, chars)


def _context(t: Letters, k: int) -> np.ndarray:
    """Hash of the k characters before each place; the same value for the same characters."""
    return np.roll(t.grams[k - 1], 1) if k else np.zeros(len(t.word), np.uint64)


def _tally(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, where = np.unique(key, return_inverse=True)
    return u, np.bincount(where, weight, len(u))


class CharacterModel:
    """One language's sorted arrays: per order the n-grams' discounted probabilities and the contexts' back-off weights."""

    def __init__(self, t: Letters, count: np.ndarray):
        weight = count[t.word]
        predicted = t.depth > 0
        self.grams, self.values, self.contexts, self.backoff = [], [], [], []
        self.floor = 1.0 / max(64, 2 * len(np.unique(t.chars)))
        for k in range(1, ORDER + 1):
            full = predicted & (t.depth >= k - 1) & (weight > 0)
            place = np.flatnonzero(full)
            gram, context = t.grams[k - 1][place], _context(t, k - 1)[place]
            u, at, where = np.unique(gram, return_index=True, return_inverse=True)
            n = np.bincount(where, weight[place], len(u))
            if k < ORDER:
                # not at a word's start: the number of different characters before the n-gram
                longer = t.depth[place] >= k
                pairs, one = np.unique(t.grams[k][place[longer]], return_index=True)
                kinds = np.bincount(where[np.flatnonzero(longer)[one]], minlength=len(u))
                begins = np.bincount(where[~longer], weight[place[~longer]], len(u))
                n = kinds + begins
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.75
            c, cw = np.unique(context[at], return_inverse=True)
            total, kinds = np.bincount(cw, n, len(c)), np.bincount(cw, minlength=len(c))
            self.grams.append(u)
            self.values.append(np.maximum(n - d, 0) / total[cw])
            self.contexts.append(c)
            self.backoff.append((total - np.bincount(cw, np.maximum(n - d, 0), len(c))) / total)

    def bits(self, t: Letters, size: int) -> np.ndarray:
        """Bits of each word."""
        p = np.full(len(t.word), self.floor)
        for k in range(1, ORDER + 1):
            place, g, of_gram, c, of_context = t.lookups(k)
            i = np.minimum(np.searchsorted(self.contexts[k - 1], c), len(self.contexts[k - 1]) - 1)
            weight = np.where(self.contexts[k - 1][i] == c, self.backoff[k - 1][i], 1.0)
            j = np.minimum(np.searchsorted(self.grams[k - 1], g), len(self.grams[k - 1]) - 1)
            seen = np.where(self.grams[k - 1][j] == g, self.values[k - 1][j], 0.0)
            p[place] = weight[of_context] * p[place] + seen[of_gram]
        return np.bincount(t.word, -np.log2(p) * (t.depth > 0), size)


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its line and its sentence, counted over the chunk, and whether it has letters."""
    feeds = np.cumsum(w.codes == 10)
    stop = np.isin(w.codes, _STOPS)
    marks = np.cumsum((w.codes == 10) | stop)
    digits = np.cumsum(np.concatenate(([0], (w.codes >= 48) & (w.codes <= 57))))
    return feeds[w.start], marks[w.start], (digits[w.end] - digits[w.start]) < (w.end - w.start)


class Scorer:
    """Scores words against all models, each distinct word once."""

    MOST = 1_000_000

    def __init__(self, models: list[CharacterModel]):
        self.models = models
        self.known, self.bits = np.zeros(0, np.uint64), np.zeros((len(models), 0), np.float32)

    def __call__(self, w: Words) -> np.ndarray:
        u, at, where = np.unique(w.hash, return_index=True, return_inverse=True)
        i = np.searchsorted(self.known, u)
        new = np.ones(len(u), bool)
        inside = i < len(self.known)
        new[inside] = self.known[i[inside]] != u[inside]
        if new.any():
            t = letters(w, at[new])
            fresh = np.stack([m.bits(t, int(new.sum())) for m in self.models]).astype(np.float32)
            if len(self.known) > self.MOST:
                self.known, self.bits = self.known[:0], self.bits[:, :0]
                return self(w)
            self.known, self.bits = np.concatenate((self.known, u[new])), np.concatenate((self.bits, fresh), axis=1)
            order = np.argsort(self.known)
            self.known, self.bits = self.known[order], self.bits[:, order]
        return self.bits[:, np.searchsorted(self.known, u)][:, where]


def _sum(groups: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(groups, r, n) for r in rows])


def _sentences(w: Words, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per word its line and sentence; per line its index and bits; per sentence its line and bits, the line's own model favoured; and which words have letters."""
    line, sentence, alpha = _units(w)
    lines, li = np.unique(line, return_inverse=True)
    b = bits * alpha
    total = _sum(li, len(lines), b)
    sentences, si = np.unique(sentence, return_inverse=True)
    of_sentence = _sum(si, len(sentences), b)
    owner = np.zeros(len(sentences), np.int64)
    owner[si] = li
    of_sentence[total.argmin(0)[owner], np.arange(len(sentences))] -= STAY
    return li, si, lines, total, owner, of_sentence, alpha


def judge_lines(w: Words, bits: np.ndarray, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, ...]:
    """Per line with words: (index of line, words, class by words, bits of each class, characters)."""
    li, si, lines, total, _, of_sentence, alpha = _sentences(w, bits)
    n = len(lines)
    chosen = classes[of_sentence.argmin(0)]
    votes = np.bincount(li * n_classes + chosen[si], alpha, n * n_classes).reshape(n, n_classes)
    size = np.bincount(li, (w.end - w.start + 1) * alpha, n)
    return lines, np.bincount(li, minlength=n), votes.argmax(1), total, size


@dataclass
class LanguageModels:
    languages: list[str]
    classes: np.ndarray  # the language of each model; a language written in two scripts has two
    models: list[CharacterModel]
    temperature: float = 1.0
    limits: np.ndarray | None = None


def _confidence(total: np.ndarray, classes: np.ndarray, n: int, temperature: float) -> np.ndarray:
    z = -total * np.log(2) * temperature
    z = np.exp(z - z.max(0))
    by = np.stack([z[classes == c].sum(0) for c in range(n)])
    return by / by.sum(0)


def _models(t: Letters, word: np.ndarray, li: np.ndarray, alpha: np.ndarray, language: np.ndarray, script: np.ndarray, doc: np.ndarray, weight: np.ndarray, held: np.ndarray) -> dict[tuple[int, bool], CharacterModel]:
    """A model of each (language, script) kind of lines, however small its share of the language.

    Of each language the kind that stands for most documents has one. Another needs lines of several documents, and has none
    if some model of another language predicts half of them about as well as one of the other half: their labels are wrong.
    """
    size = int(t.word[-1]) + 1
    characters = np.bincount(t.word, t.depth > 0, size)[word]
    made = lambda pick: CharacterModel(t, np.bincount(word[pick], minlength=size))
    kinds = {}
    for a, cyr in set(zip(language.tolist(), script.tolist())):
        own = (language == a) & (script == cyr) & ~held
        pick = own[li] & alpha
        if pick.sum() >= LEAST_WORDS:
            docs = np.unique(doc[own])
            kinds[a, cyr] = weight[docs].sum(), docs, pick
    total = np.bincount([a for a, _ in kinds], [n for n, _, _ in kinds.values()]) if kinds else []
    # wrong labels are a smaller share of their language than right ones
    order = sorted(kinds, key=lambda k: (-kinds[k][0] / total[k[0]], k))
    main = {a: (a, cyr) for a, cyr in reversed(order)}
    out = {k: made(kinds[k][2]) for k in order if main[k[0]] == k}
    for k in order:
        if k in out or len(kinds[k][1]) < LEAST_DOCS:
            continue
        _, docs, pick = kinds[k]
        half = np.isin(doc, docs[::2])[li]
        test = pick & ~half
        if not test.any() or not (pick & half).any():
            continue
        rate = lambda m: m.bits(t, size)[word[test]].sum() / characters[test].sum()  # noqa: B023, E731
        others = [rate(m) for x, m in out.items() if x[0] != k[0]]
        if not others or rate(made(pick & half)) < MUCH_BETTER * min(others):
            out[k] = made(pick)
    return dict(sorted(out.items()))


def fit(labelled: list[tuple[str, str]], stands_for: list[float] | None = None) -> LanguageModels | None:
    """Models from (language, text) rows; stands_for: how many documents each row was sampled from, 1 if not given."""
    languages = [x for x in LABELS if any(a == x for a, _ in labelled)]
    if not languages:
        return None
    w = words([t for _, t in labelled])
    line, _, alpha = _units(w)
    lines, li = np.unique(line, return_inverse=True)
    given = np.array([languages.index(a) for a, _ in labelled])[w.text]
    language = np.zeros(len(lines), np.int64)
    language[li] = given
    doc = np.zeros(len(lines), np.int64)
    doc[li] = w.text
    weight = np.ones(len(labelled)) if stands_for is None else np.array(stands_for)
    cyrillic = np.concatenate(([0], np.cumsum((w.codes >= 0x400) & (w.codes < 0x530))))
    script = np.bincount(li, cyrillic[w.end] - cyrillic[w.start], len(lines)) * 2 > np.bincount(li, w.end - w.start, len(lines))
    u, at, word = np.unique(w.hash, return_index=True, return_inverse=True)
    t = letters(w, at)
    held = (mix(lines.astype(np.uint64)) % np.uint64(8)) == 0
    out = None
    for r in range(ROUNDS):
        found = _models(t, word, li, alpha, language, script, doc, weight, held)
        models, classes = list(found.values()), [a for a, _ in found]
        if not models:
            return None
        out = LanguageModels(languages, np.array(classes), models)
        bits = np.stack([m.bits(t, len(u)) for m in models])[:, word] * alpha
        total = _sum(li, len(lines), bits)
        if r + 1 < ROUNDS:
            language = out.classes[total.argmin(0)]
    size = np.bincount(li, (w.end - w.start + 1) * alpha, len(lines))
    test = held & (np.bincount(li, minlength=len(lines)) >= 4) & (size > 0)
    truth = language[test]
    # one more error than was seen keeps the confidence below certainty where there was none
    best, out.temperature, slack = np.inf, 1.0, 1 / (len(truth) + 2)
    for x in (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0):
        c = np.log(np.maximum(_confidence(total[:, test], out.classes, len(languages), x), 1e-300))
        right = c[truth, np.arange(len(truth))]
        loss = -((1 - slack) * right + slack * (c.sum(0) - right) / max(1, len(languages) - 1)).sum()
        if loss < best:
            best, out.temperature = loss, x
    rate = total.min(0)[test] / size[test]
    out.limits = np.array([rate[truth == a].mean() + 8 * rate[truth == a].std() + 1.5 if (truth == a).any() else np.inf for a in range(len(languages))])
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModels | None:
    """Models from docs(id, label, content): about ``sample`` different texts of each language that a label names and each script."""
    named = docs.select("id", named_language(F.col("label")).alias("language"), "content").where("language IS NOT NULL AND content IS NOT NULL")
    letters = F.length(F.regexp_replace("content", r"[^\p{L}]+", ""))
    cyrillic = F.length(F.regexp_replace("content", r"[^\u0400-\u052f]+", "")) * 2 > letters
    # copies have the same hash and are taken once
    named = named.select("language", "content", F.xxhash64("content").alias("hash"), cyrillic.cast("int").alias("script"))
    counts = {(r["language"], r["script"]): r["n"] for r in named.groupBy("language", "script").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not counts:
        return None
    shares = {k: min(1.0, sample / n) for k, n in counts.items()}
    share = F.create_map(*[F.lit(x) for (a, s), v in shares.items() for x in (f"{a} {s}", v)])
    some = named.where(F.pmod("hash", F.lit(10**15)) < share[F.concat_ws(" ", "language", "script")] * 10.0**15).dropDuplicates(["language", "hash"])
    rows = some.select("hash", "language", "script", "content").orderBy("hash", "language").limit(4 * sample * len(shares)).collect()
    return fit([(r["language"], r["content"]) for r in rows], [1 / shares[r["language"], r["script"]] for r in rows])


def language_of_lines(docs: DataFrame, models: LanguageModels | None, least_words: int = 1) -> DataFrame:
    """docs(id, label, content) to a row per line of at least least_words words; language is null where rejected."""
    spark = docs.sparkSession
    docs = docs.select(F.col("id").cast("string"), "label", "content").where("content IS NOT NULL AND id IS NOT NULL")
    if models is None:
        return spark.createDataFrame([], LINES)
    sent = spark.sparkContext.broadcast(models)

    def judge(batches):
        m = sent.value
        scorer, names = Scorer(m.models), np.array([*m.languages, None], object)
        for b in batches:
            texts = b.column(2).to_pylist()
            for s, e in chunks(texts):
                w = words(texts[s:e])
                if not len(w.hash):
                    continue
                bits = scorer(w)
                lines, n, language, total, size = judge_lines(w, bits, m.classes, len(m.languages))
                confidence = _confidence(total, m.classes, len(m.languages), m.temperature)[language, np.arange(len(n))]
                own = np.stack([total[m.classes == a].min(0) for a in range(len(m.languages))])[language, np.arange(len(n))]
                rate = own / np.maximum(size, 1)
                refused = (size == 0) | (confidence < LEAST_CONFIDENCE) | (rate > m.limits[language])
                text = np.zeros(len(n), np.int64)
                line_of_word = np.searchsorted(lines, np.cumsum(w.codes == 10)[w.start])
                text[line_of_word] = w.text
                feeds = np.cumsum(w.codes == 10)
                base = np.where(w.text_at[:-1] > 0, feeds[np.maximum(w.text_at[:-1] - 1, 0)], 0)
                keep = np.flatnonzero(n >= least_words)
                at = pa.array(text[keep] + s)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at), b.column(1).take(at), pa.array(lines[keep] - base[text[keep]], pa.int32()), pa.array(n[keep], pa.int32()),
                        pa.array(names[np.where(refused, len(m.languages), language)[keep]], pa.string()), pa.array(confidence[keep]), pa.array(rate[keep]),
                    ],
                    ["id", "label", "line_no", "words", "language", "confidence", "bits"],
                )

    return docs.mapInArrow(judge, LINES)


def language_of_segments(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """docs(id, content) to a row per segment: a run of a line's sentences in one language, by its place in the content; language is null where rejected."""
    spark = docs.sparkSession
    docs = docs.select(F.col("id").cast("string"), "content").where("content IS NOT NULL AND id IS NOT NULL")
    if models is None:
        return spark.createDataFrame([], SEGMENTS)
    sent = spark.sparkContext.broadcast(models)

    def judge(batches):
        m = sent.value
        scorer, names = Scorer(m.models), np.array([*m.languages, None], object)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s, e in chunks(texts):
                w = words(texts[s:e])
                if not len(w.hash):
                    continue
                bits = scorer(w)
                li, si, lines, _, owner, of_sentence, alpha = _sentences(w, bits)
                chosen = m.classes[of_sentence.argmin(0)]
                run = np.cumsum(np.append(True, (np.diff(owner) != 0) | (np.diff(chosen) != 0))) - 1
                n = int(run[-1]) + 1
                of_word = run[si]
                total = _sum(of_word, n, bits * alpha)
                language = np.zeros(n, np.int64)
                language[run] = chosen
                confidence = _confidence(total, m.classes, len(m.languages), m.temperature)[language, np.arange(n)]
                size = np.bincount(of_word, (w.end - w.start + 1) * alpha, n)
                own = np.stack([total[m.classes == a].min(0) for a in range(len(m.languages))])[language, np.arange(n)]
                refused = (size == 0) | (confidence < LEAST_CONFIDENCE) | (own / np.maximum(size, 1) > m.limits[language])
                first, last = np.searchsorted(of_word, np.arange(n)), np.searchsorted(of_word, np.arange(n), "right") - 1
                text = w.text[first]
                feeds = np.cumsum(w.codes == 10)
                base = np.where(w.text_at[:-1] > 0, feeds[np.maximum(w.text_at[:-1] - 1, 0)], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(text + s)), pa.array(feeds[w.start[first]] - base[text], pa.int32()), pa.array(w.start[first] - w.text_at[text], pa.int32()), pa.array(w.end[last] - w.start[first], pa.int32()),
                        pa.array(np.bincount(of_word, minlength=n), pa.int32()), pa.array(names[np.where(refused, len(m.languages), language)], pa.string()), pa.array(confidence),
                    ],
                    ["id", "line_no", "begin", "length", "words", "language", "confidence"],
                )

    return docs.mapInArrow(judge, SEGMENTS)


def language_of_documents(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, language, confidence, share): the language of most words of each of docs(id), null with confidence 0 where no line has one."""
    lines = lines.where("language IS NOT NULL").dropDuplicates(["id", "line_no"])
    per = lines.groupBy("id", "language").agg(F.sum("words").alias("words"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence"))
    best = per.groupBy("id").agg(F.max_by(F.struct("language", "confidence", "words"), F.struct("words", "language")).alias("best"), F.sum("words").alias("all"))
    every = docs.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).distinct().join(best, "id", "left")
    return every.select("id", "best.language", F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.col("best.words") / F.col("all"), F.lit(0.0)).alias("share"))


def mislabelled_lines(docs: DataFrame, models: LanguageModels | None, least_words: int = 8) -> DataFrame:
    """(id, line_no, true_language) of the lines whose language isn't the one that the document's label names."""
    lines = language_of_lines(docs, models, least_words).where("language IS NOT NULL")
    other = lines.where(~named_language(F.col("label")).eqNullSafe(F.col("language")))
    return other.select("id", F.col("line_no").cast("long").alias("line_no"), F.col("language").alias("true_language")).distinct()
