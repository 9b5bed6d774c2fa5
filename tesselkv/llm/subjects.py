"""Subject areas of posts, by n-gram language models of the post's own words.

Each subject has a bigram model interpolated with its unigrams, and these with the
background of all subjects.  A sentence belongs to the subject whose model beats
the background's cross-entropy on it by most, if by enough; a post has the
subjects that hold enough of its own sentences.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENERAL = "general"
# A subject's own share of its model, smoothing of bigrams, steps of the fit.
OWN, MU, STEPS = 0.3, 1.0, 12
# A word in fewer sentences than this is a name or an error, and evidence of nothing.
RARE = 4
_RARE_WORD = "\0"
# Sentences a model remembers.
REMEMBERED = 30_000

_BREAK = regex.compile(r"<br ?/?>|</p>|</td>|<p>", regex.I)
_QUOTES = [regex.compile(r"\[quote[^\]\n]*\](?:(?!\[quote).)*?\[/quote\]", regex.I | regex.S), regex.compile(r"<blockquote>(?:(?!<blockquote).)*?</blockquote>", regex.I | regex.S)]
_OPEN_QUOTE = regex.compile(r"(?:\[quote[^\]\n]*\]|<blockquote>).*?(?=\n[ \t]*\n|\Z)", regex.I | regex.S)
_SAID = regex.compile(r"[\w@]+ said “[^”]*(?:”|\Z)", regex.S)
_QUOTED_LINE = regex.compile(r"^[ \t]*[>|].*$", regex.M)
_ATTRIBUTION = regex.compile(r"^.{0,60}\b(?:wrote|Zitat von \w+|escribió|a écrit)\s?:[ \t]*$", regex.M)
_SIGNATURES = [
    regex.compile(r"<div class=\"sig\">.*?(?:</div>|\Z)", regex.I | regex.S), regex.compile(r"\[size=1\].*?(?:\[/size\]|\Z)", regex.I | regex.S),
    regex.compile(r"^(?:--|__{3,}|- - -|~~~+|\*\*\*+|==+)[ \t]*\n(?:(?!\n[ \t]*\n).)*\Z", regex.M | regex.S), regex.compile(r"^Sent from my .*$", regex.M | regex.I),
]
_TAG = regex.compile(r"</?[a-z!][^<>\n]{0,200}>|\[/?[a-z*]+(?:=[^\]\n]*)?\]", regex.I)
_REMOVED = regex.compile(r"^\W*(?:this )?(?:post|message)?\W*(?:has been |was )?(?:removed|deleted)(?: by (?:the )?\w+)?\W*$", regex.I)
_SENTENCE = regex.compile(r"(?<=[.!?…])\s+|\n+")
_NOT_WORDS = regex.compile(r"https?://\S+|@\w+|:\w+:|\b\w+_\w+\b|^\+1\b")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*|\p{N}+|[^\s\p{L}\p{N}]")


def own_words(text: str | None) -> str:
    """A post without quotes, signatures and markup; "" for a notice of removal.

    Quotes may be nested and in several notations; one that is not closed ends with
    its paragraph.
    """
    if not text or not text.strip():
        return ""
    t = html.unescape(html.unescape(text)).replace("\r\n", "\n").replace("\r", "\n")
    if _REMOVED.match(_TAG.sub("", t).strip()):
        return ""
    t = _BREAK.sub("\n", t)
    for quote in _QUOTES:
        n = 1
        while n:
            t, n = quote.subn("\n", t)
    for gone in (_SAID, *_SIGNATURES, _OPEN_QUOTE, _QUOTED_LINE, _ATTRIBUTION):
        t = gone.sub("\n", t)
    return _TAG.sub("", t).strip()


def sentences(text: str) -> list[tuple[str, ...]]:
    """Words of each sentence, in lower case, numbers as 0."""
    out = []
    for s in _SENTENCE.split(text):
        words = ("0" if w[0].isnumeric() else w for w in _WORD.findall(_NOT_WORDS.sub(" ", s.lower())))
        if any(c.isalpha() for c in s):
            out.append(tuple(words))
    return out


class SubjectModels:
    """One interpolated bigram model per subject, and one of everything.

    A subject's model mixes its own bigrams and unigrams with the background.  Its
    own part is fitted by expectation-maximisation to what the background does not
    explain, so greetings and turns of phrase that all subjects share are left to
    the background.  ``gain(words)`` is, per subject, by how many nats its model
    beats the background on a sentence: the difference of their cross-entropies,
    summed over the words.
    """

    def __init__(self, subjects: Sequence[str]):
        self.subjects = list(subjects)
        self.row: dict[str | tuple[str, str], int] = {}
        self.known: set[str] = set()
        self.gains: dict[tuple[str, ...], np.ndarray] = {}
        self.table = np.zeros((0, len(self.subjects)), np.float32)

    def fit(self, weighted: Sequence[tuple[tuple[str, ...], np.ndarray]], balanced: bool = True) -> SubjectModels:
        """From sentences with a weight per subject; rare words are one word.

        If ``balanced``, every subject weighs the same in the background, however
        often it occurs.
        """
        each_once: dict[tuple[str, ...], np.ndarray] = {}
        times: Counter[tuple[str, ...]] = Counter()
        for words, weight in weighted:
            each_once[words] = each_once[words] + weight if words in each_once else weight
            times[words] += 1
        weighted = list(each_once.items())
        seen: Counter[str] = Counter()
        for words, n in times.items():
            for w in set(words):
                seen[w] += n
        self.gains = {}
        self.known = {w for w, n in seen.items() if n >= RARE}
        ones: dict[str, int] = {}
        twos: dict[tuple[str, str], int] = {}
        at1, at2, first, weights, sizes = [], [], [], [], []
        for words, weight in weighted:
            before = ""
            for w in self.common(words):
                at1.append(ones.setdefault(w, len(ones)))
                first.append(ones.setdefault(before, len(ones)))
                at2.append(twos.setdefault((before, w), len(twos)))
                before = w
            weights.append(weight)
            sizes.append(len(words))
        if not ones:
            return self
        k = len(self.subjects)
        each = np.repeat(np.array(weights, np.float32), sizes, axis=0)
        c1, c2, ch = np.zeros((len(ones), k)), np.zeros((len(twos), k)), np.zeros((len(ones), k))
        for to, at in ((c1, at1), (c2, at2), (ch, first)):
            np.add.at(to, at, each)
        if balanced:
            weigh = c1.sum(0).mean() / np.maximum(c1.sum(0), 1.0)
            c1, c2, ch = c1 * weigh, c2 * weigh, ch * weigh
        base = (c1.sum(1) + 0.5) / (c1.sum() + 0.5 * len(ones))
        own = c1 / np.maximum(c1.sum(0), 1e-9)
        for _ in range(STEPS):
            explained = c1 * (OWN * own) / ((1 - OWN) * base[:, None] + OWN * own + 1e-30)
            own = explained / np.maximum(explained.sum(0), 1e-9)
        share = OWN * own / ((1 - OWN) * base[:, None] + OWN * own + 1e-30)
        h2, w2 = (np.array([ones[x[i]] for x in twos]) for i in (0, 1))
        base2 = (c2.sum(1) + MU * base[w2]) / (ch.sum(1)[h2] + MU)
        own2 = c2 * share[w2] / (ch[h2] + MU)
        self.row = {**ones, **{x: i + len(ones) for x, i in twos.items()}}
        alone = (1 - OWN) + OWN * own / base[:, None]
        paired = (1 - OWN) + OWN * (0.5 * own[w2] + 0.5 * own2) / base2[:, None]
        self.table = np.log(np.concatenate([alone, paired]) / (1 - OWN)).astype(np.float32)
        return self

    def common(self, words: Sequence[str]) -> Iterator[str]:
        return (w if w in self.known else _RARE_WORD for w in words)

    def gain(self, words: tuple[str, ...]) -> np.ndarray:
        """Zero for no words; sentences judged before are remembered, a bounded number."""
        if (found := self.gains.get(words)) is not None:
            return found
        rows, before, known, row_of = [], "", self.known, self.row.get
        for w in words:
            if w in known:
                row = row_of((before, w))
                rows.append(row_of(w) if row is None else row)
                before = w
            else:
                before = _RARE_WORD
        if len(self.gains) >= REMEMBERED:
            self.gains.clear()
        found = self.gains[words] = self.table[rows].sum(0)
        return found


class Accept(NamedTuple):
    """When a subject is accepted; fitted on labelled posts the models have not seen."""

    gain: float  # a sentence counts above this gain, in words that are one subject's alone,
    mention: float  # and unless its turns of phrase are this much more of a passing mention,
    slope: float  # allowing more where the gain is greater
    share: float  # a subject holds this share of the post's counted evidence
    bonus: float  # and the post's subjects are preferred by this much where sentences are close


GRID = [Accept(g, m, a, s, b) for g in (0.55, 0.85, 1.1) for m in (0.5, 2.0, 9.0) for a in (0.0, 0.3) for s in (0.15, 0.2, 0.25) for b in (0.0, 0.5, 1.0)]

Post = tuple[list[tuple[str, ...]], set[int]]


class SubjectClassifier:
    """Subjects of posts; ``subjects`` are all areas, GENERAL among them or not."""

    def __init__(self, subjects: Sequence[str]):
        self.names = [s for s in subjects if s != GENERAL]
        self.models = SubjectModels(self.names)
        self.mentions = SubjectModels(["own", "mention"])
        self.accept = Accept(0.85, 1.0, 0.3, 0.2, 0.5)
        # What a word gains that is one subject's alone, all subjects being as large.
        self.unit = float(np.log(1 + OWN * max(2, len(self.names)) / (1 - OWN)))

    def _train(self, posts: Sequence[Post], rounds: int = 2) -> None:
        """Labels belong to posts; which sentences carry them is found in rounds."""
        k = len(self.names)
        even = np.full(k, 1 / k)

        def spread(labels: set[int]) -> np.ndarray:
            w = np.zeros(k)
            w[list(labels)] = 1 / len(labels)
            return w

        def judged(words: tuple[str, ...], labels: set[int]) -> np.ndarray:
            g = self.models.gain(words)
            best = int(g.argmax())
            if g[best] > 1.1 * self.unit and best in labels:
                return spread({best})
            if g[best] > 2.2 * self.unit:
                return spread({best}) / 2  # a passing mention, or a missing label
            return spread(labels) if labels else even

        self.models.fit([(s, spread(labels) if labels else even) for post, labels in posts for s in post])
        for _ in range(rounds):
            self.models.fit([(s, judged(s, labels)) for post, labels in posts for s in post])
        clear = []
        for post, labels in posts:
            for s in post if labels else []:
                g = self.models.gain(s)
                if g.max() > 1.4 * self.unit:
                    clear.append((s, np.array([1.0, 0.0]) if int(g.argmax()) in labels else np.array([0.0, 1.0])))
        self.mentions.fit(clear, balanced=False)

    def evidence(self, post: Sequence[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence its gain for each subject, and how much it is a mention."""
        gains = np.array([self.models.gain(w) for w in post]).reshape(len(post), len(self.names))
        ways = np.array([self.mentions.gain(w) for w in post]).reshape(len(post), 2)
        return gains, ways[:, 1] - ways[:, 0]

    def decide(self, evidence: tuple[np.ndarray, np.ndarray], accept: Accept) -> set[int]:
        """Subjects with enough of the sentences' evidence.

        A sentence counts for its best subject.  In a second pass the subjects of the
        whole post weigh in, which settles sentences that are close between two.
        """
        gains, mention = evidence
        mass = np.zeros(len(self.names))
        for bonus in (0.0, accept.bonus * self.unit):
            prior = bonus * mass / max(mass.sum(), 1e-9)
            best = (gains + prior).argmax(1) if len(gains) else np.zeros(0, int)
            gain = gains[np.arange(len(gains)), best]
            counts = (gain > accept.gain * self.unit) & (mention < accept.mention + accept.slope * gain)
            mass = np.bincount(best[counts], np.sqrt(gain[counts]), len(self.names))
        enough = max(accept.share * mass.sum(), min(2.0, mass.max(initial=0.0)))
        return {i for i, x in enumerate(mass) if x > 0 and x >= enough}

    def fit(self, texts: Sequence[str | None], labels: Sequence[set[str]]) -> SubjectClassifier:
        """A quarter of the posts is held out to calibrate acceptance, then used too."""
        at = {s: i for i, s in enumerate(self.names)}
        posts = [(sentences(own_words(t)), {at[x] for x in l if x in at}) for t, l in zip(texts, labels, strict=True)]
        posts = [p for p in posts if p[0]]
        held = posts[::4]
        if len(held) >= 30 and self.names:
            self._train([p for i, p in enumerate(posts) if i % 4])
            known = [(self.evidence(post), true) for post, true in held]
            self.accept = max(GRID, key=lambda a: self.f1([(self.decide(e, a), true) for e, true in known]))
        if posts and self.names:
            self._train(posts)
        for m in (self.models, self.mentions):
            m.gains = {}  # not to be sent along
        return self

    @staticmethod
    def f1(pairs: Sequence[tuple[set[int], set[int]]]) -> float:
        """Over (found, true); none of the areas counts as one more area."""
        pairs = [(a or {-1}, b or {-1}) for a, b in pairs]
        return 2 * sum(len(a & b) for a, b in pairs) / max(1, sum(len(a) + len(b) for a, b in pairs))

    def subjects_of(self, text: str | None) -> list[str]:
        own = own_words(text)
        if not own or not self.names:
            return []
        found = self.decide(self.evidence(sentences(own)), self.accept)
        return [self.names[i] for i in sorted(found)] or [GENERAL]


#: Labelled posts that the models are fitted to, at most; they come to the driver.
TRAINING_POSTS = 6000


def fit_classifier(docs: DataFrame, labels: DataFrame, areas: DataFrame, training_posts: int = TRAINING_POSTS) -> SubjectClassifier:
    """Fitted to the labelled posts whose id has the least hash, ``training_posts`` at most.

    Spellings of a subject that differ in case or in blanks around it are the same;
    null and unknown subjects are left out.
    """
    names = [r.subject for r in areas.where("subject IS NOT NULL").orderBy("subject").collect()]
    plain = {n.strip().lower(): n for n in names}
    said = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(list(plain)) & F.col("doc_id").isNotNull())
    few = said.groupBy("doc_id").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_posts)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id").collect()
    rows.sort(key=lambda r: r.doc_id)
    return SubjectClassifier(names).fit([r.text for r in rows], [{plain[x] for x in r.s} for r in rows])


def classify(docs: DataFrame, classifier: SubjectClassifier) -> DataFrame:
    """Columns doc_id, subject: a row for each subject of each post.

    Null, empty and blank texts, notices of removal and posts of nothing but quotes
    and signatures have no row; own words of no other area give 'general'.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            at, names = [], []
            for i, text in enumerate(batch.column(1)):
                found = own.subjects_of(text.as_py())
                at += [i] * len(found)
                names += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], names=["doc_id", "subject"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, subject string")
