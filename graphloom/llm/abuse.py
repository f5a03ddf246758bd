"""Abusive, hateful or sexual content: boosted trees over dense features, calibrated.

Each text is read once and reduced to ``FEATURES``: densities of lexicon hits by kind,
turns of speech that attack (a threat, a wish of harm, a dismissal, people called vermin, people to be
driven out, a sexual demand: each a pattern over word classes, not a list of sentences),
their nearness to the second person, what the worst sentence holds, and rates of
capitals, punctuation and obfuscation. Obfuscated spellings (leet digits, masked
or spaced letters, stretched letters, invisible characters) are undone before the look-up.

Gradient-boosted trees (logistic loss, second order, ``DEPTH`` levels over histograms) are
fitted to reviewers' majority labels of a bounded sample of labelled documents
(``MAX_LABELS``, by hash of the id), whose features alone reach the driver. The scores are
mapped to probabilities by isotonic regression on scores each labelled document got from
trees that hadn't seen it (``FOLDS`` cross-folds), and every document gets the calibrated
score. One and the same fit serves few labels and many: its leaves are shrunk, its folds
always cover all labels. Labels may be wrong here and there; trees of ``DEPTH`` with many
cases a leaf can't follow single ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents used at most; they are those of the smallest hash of their id.
MAX_LABELS = 20_000
DEPTH, TREES, LEAF, RATE, SHRINK, BINS, FOLDS = 3, 40, 5, 0.15, 2.0, 64, 5

# Words by kind, in the four languages, as they read without accents and obfuscation.
INSULT = """bastard bastards slut sluts whore whores bitch bitches cunt cunts arsehole arseholes asshole assholes shithead dickhead dickheads prick pricks wanker wankers twat twats
fucker fuckers motherfucker motherfuckers fuck fucking fucked bullshit shit shits retard retards faggot faggots moron morons degenerate degenerates scumbag scumbags skank tosser arse
puta putas puto putos cabron cabrones gilipollas zorra zorras hijoputa mierda pendejo pendejos maricon asquerosa asqueroso imbecil
salope salopes putain pute putes connard connards connasse encule encules enculee merde ordure ordures batard fumier gueule
arschloch arschlocher hure huren miststuck miststucke schlampe schlampen wichser fotze scheisse scheiss hurensohn fresse drecksau abschaum""".split()  # fmt: skip
SLIGHT = """scum vermin filth garbage trash parasite parasites rat rats pig pigs dog dogs animals coward cowards stinking filthy rotten worthless pathetic disgusting brainless dirty idiot idiots loser losers stupid cheap
rata ratas basura cerdo cerdos cerda perro perra asco vermine sale sales espece pourriture porc porcs cochon chien chienne
schwein schweine dreckig dreckiges dreckiger dreckige ratte ratten ungeziefer dreck mull sau hund""".split()  # fmt: skip
SEXUAL = """naked nude nudes tits boobs pussy cock dick blowjob cum grope groped screw moaned moaning rode horny wet bed strip sexy fuck fucked porn
desnuda desnudo tetas polla cama follar nue nu lit baiser seins nackt bett titten ficken geil""".split()  # fmt: skip
HATE = """breed birth deserves women men driven burn them among us all out thing echarlos todos chasser tous vertrieben gehoren alle habria faut""".split()
SECOND = """you your yours yourself u ur tu te ti tus tuyo eres vous votre vos toi ton ta tes du dich dir dein deine deinem deiner ihr euch euer""".split()
# Word classes of the attacking turns of speech, in the four languages.
HARM = """kill slit stab shoot cut break smash beat crush strangle choke rape gut skin hang burn bury hurt punch kick rip destroy murder drown
matar matare mato romper rompo partir parto reventar reviento quemar quemo ahorcar degollar golpear hundir tuer tue casser casse egorger crever creve frapper bruler buter pendre
toten umbringen umbringe schlagen schlage brechen breche aufschlitzen verbrennen erschlagen erwurgen abstechen zertreten""".split()  # fmt: skip
DEATH = """die dies dead rot choke burn hang drown suffer beaten shot disappear gutted muera muere mueras pudra pudras ahorques creve creves crever meurs pourrisse pendre verrecke verreckst verrecken sterben krepier krepieren verrotte""".split()
WISH = """hope hopes wish deserve deserves deserved should ought go nobody please better want espero ojala mereces merece deberias espere souhaite merites merite devrais hoffe hoffentlich wunsche verdienst solltest""".split()
BODY = """throat face skull neck teeth head guts bones knees jaw mouth cara cuello garganta cabeza dientes crane gorge tete cou dents gueule visage kehle hals kopf schadel zahne knochen gesicht fresse maul""".split()
VERMIN = """subhuman subhumans cockroach cockroaches maggots insects savages plague cancer disease inferior untermenschen untermensch cucarachas infrahumanos plaga gusanos salvajes cafards sauvages parasites nuisibles kakerlaken maden parasiten seuche bestien tiere animales animaux betes""".split()
GROUP = """they them those these people all men women folk lot kind race sort everyone whole bunch ellos ellas esos esas todos todas gente ils elles eux ceux ces tous toutes gens sie die diese alle leute volk sippe family families clan tribe""".split()
OUT = """burn drive driven throw thrown kick kicked chase wipe wiped deport deported exterminate exterminated gas gassed clear cleared echar echarlos echarlas fuera expulsar expulsarlos quemarlos chasser chasses chasse dehors expulser expulses vertrieben vertreiben raus ausrotten rauswerfen verjagen abschieben""".split()
DEMAND = """send show want wanna need strip spread undress imagine quiero manda mandame ensename desnudate veux envoie montre deshabille will mochte schick zeig ausziehen zieh""".split()
# Dismissals and set phrases of abuse.
DISMISS = (
    r"(?:get|go) lost", r"shut (?:up|your)", r"drop dead", r"(?:piss|fuck|sod|bugger) off", r"(?:screw|fuck|damn|curse) (?:you|him|her|them)", r"go to hell", r"rot in hell", r"kiss my", r"(?:kill|hang|drown|shoot) yoursel(?:f|ves)", r"go back (?:to|where)", r"crawl back",
    r"(?:would|will|d) (?:ever )?miss you", r"breeds? like", r"(?:do not|dont|not) belong (?:here|among)", r"live among (?:us|decent)", r"by birth", r"nothing but an?", r"piece of", r"good for nothing", r"waste of (?:space|air|breath|skin)",
    r"callate", r"vete (?:a la|al)", r"pedazo de", r"no vales (?:nada|una)", r"hijos? de", r"(?:no eres|sois) mas que", r"ferme (?:ta|la)", r"espece de", r"casse toi", r"va te faire", r"degage", r"(?:n es|ne vaux|vaut) (?:qu un|rien)", r"bande de", r"sale race",
    r"halt (?:die|dein|deine) (?:fresse|klappe|schnauze|maul|mund)", r"verpiss dich", r"leck mich", r"fick dich", r"sonst nichts", r"nichts als", r"du (?:bist|dreckige?s?|elende?s?)", r"geh sterben", r"stuck (?:dreck|scheisse)",
)
# Clinical and legal words that make a hit near them ordinary.
SOBER = """genital vaginal examination swabs semen section offence medical corroboration wound exhibit forensic injury autopsy court evidence post-mortem anus breasts nipples pups""".split()

FEATURES = ("insult", "slight", "sexual", "attack", "hate", "second_near", "worst", "worst_insult", "worst_second", "worst_attack", "worst_caps", "worst_punct", "obfuscated", "worst_obfuscated", "caps", "punctuation", "exclaim", "sober", "length")

_LEET = str.maketrans("013457@$!|8", "oieastasiib")
_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_SPACED = re.compile(r"(?<![\w'])(?:\w[ .\-_*]){3,}\w(?![\w'])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_TOKEN = re.compile(r"[\w@$!|*]+", re.UNICODE)
_MASKED = re.compile(r"^[a-z]+\*+[a-z]*$")


def _class(words: list[str]) -> str:
    return f"(?:{'|'.join(words)})"


def _near(a: list[str], b: list[str], gap: int, either: bool = True) -> str:
    """A word of ``a`` and one of ``b`` with at most ``gap`` words between; in either order if so wanted."""
    between = rf"(?: \w+){{0,{gap}}} "
    return rf"{_class(a)}{between}{_class(b)}" + (rf"|{_class(b)}{between}{_class(a)}" if either else "")


#: Threat, wish of harm, dismissal, people called vermin, people to be driven out, sexual demand.
ATTACKS = (
    rf"{_class(HARM)}(?: \w+){{0,2}} {_class([w for w in SECOND if w not in ('du', 'ti', 'tu', 'te')])}(?: \w+){{0,2}}(?: {_class(BODY)})?", rf"(?:{_class([w for w in SECOND if len(w) > 2])} {_class(BODY)} (?:\w+ ){{0,2}}(?:in|off|open|out|smashed|kicked|broken|ein|auf|casser|romper))|(?:te|te la|te voy a|je vais te|ich werde dir) {_class(HARM)}|(?:ich|wir) \w+ (?:dich|euch|dir)(?: \w+){{0,3}} {_class(HARM)}",
    _near(WISH, DEATH, 4, False), "|".join(DISMISS),
    rf"{_class(GROUP)}(?: \w+){{0,6}} (?:are|is|were|son|es|sont|est|sind|ist)(?: \w+){{0,4}} {_class(sorted({*VERMIN, *SLIGHT}))}",
    rf"{_class(OUT)}(?: \w+){{0,2}} {_class(GROUP)}|{_class(GROUP)}(?: \w+){{0,5}} {_class(OUT)}",
    rf"{_class(DEMAND)}(?: \w+){{0,4}} {_class(sorted({*SEXUAL} - {'bed', 'lit', 'bett', 'wet', 'rode'}))}",
)
_ATTACK = re.compile(r"\b(?:" + "|".join(f"(?:{a})" for a in ATTACKS) + r")\b")
_STRETCH = re.compile(r"(.)\1{2,}")
_INSULT, _SLIGHT, _SEXUAL, _HATE, _SECOND, _SOBER = map(frozenset, (INSULT, SLIGHT, SEXUAL, HATE, SECOND, SOBER))
_ALL = _INSULT | _SLIGHT | _SEXUAL


#: Signs inside words, single letters in a row, letters three times over: what obfuscated spellings have.
_ODD = re.compile(r"[@$*|!0-9](?=[a-z@$*|])|[a-z][@$*|0-9]|(?<![\w'])\w[ .\-_*]\w[ .\-_*]\w[ .\-_*]|([a-z])\1\1")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")
#: Words without which no attack can be there.
_CUES = frozenset((*HARM, *DEATH, *VERMIN, *OUT, *(w for a in DISMISS for w in re.findall(r"[a-z]{4,}", re.sub(r"\(\?:|[?+*{}\[\]()|\\]", " ", a))))) - frozenset("your will would here miss them like that birth among nothing live piece good".split()) | frozenset("birth among breed breeds piece belong".split())
_TRIGGERS = _INSULT | _SLIGHT | _SEXUAL | _CUES
_PUNCT = re.compile(r"[!?*#@$%&~^]|\.{3,}")


def _collapse(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


_SQUEEZED = {_collapse(w): w for w in sorted(_ALL, reverse=True)}
_MASKS: dict[tuple[str, str, int], str] = {}
for _w in sorted(_INSULT | _SLIGHT):
    if len(_w) > 3:
        _MASKS[_w[0], _w[-1], len(_w)] = _w
        _MASKS.setdefault((_w[0], "", len(_w)), _w)


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text).replace("ß", "ss") if not unicodedata.combining(c))


def _gather(m: re.Match) -> str:
    """A run of single letters as one word; a one-letter word before or after a listed one stays apart."""
    w = re.sub(r"[ .\-_*]", "", m[0])
    if w not in _ALL:
        if w[1:] in _ALL:
            return f"{w[0]} {w[1:]}"
        if w[:-1] in _ALL:
            return f"{w[:-1]} {w[-1]}"
    return w


def reveal(token: str) -> tuple[str, bool]:
    """The word a token stands for and whether it was obfuscated."""
    if token in _ALL or (token.isalpha() and not _STRETCH.search(token)):
        return token, False
    if _MASKED.match(token):
        hit = _MASKS.get((token[0], token[-1] if token[-1] != "*" else "", len(token))) or (_MASKS.get((token[0], token[-2], len(token) - 1)) if token[-1] == "s" and len(token) > 2 else None)
        return hit or token, hit is not None
    if _STRETCH.search(token) and token.isalpha():
        w = _SQUEEZED.get(_collapse(token))
        return (w, True) if w else (token, False)
    if any(c in "013457@$!|8" for c in token) and any(c.isalpha() or c in "@$" for c in token):
        w = token.strip("!|").translate(_LEET)
        if w in _ALL:
            return w, True
        w = _SQUEEZED.get(_collapse(w))
        return (w, True) if w else (token, False)
    return token, False


def features(text: str | None) -> list[float]:
    """``FEATURES`` of one text; of a null or empty one all 0."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    total = dict.fromkeys(("insult", "slight", "sexual", "hate", "near", "attack", "obf", "sober"), 0)
    n_words, worst = 0, (0.0, 0, 0, 0, 0.0, 0.0, 0)
    for raw in _SENTENCE.split(" ".join(text.split())):
        clear = _INVISIBLE.sub("", raw) if not raw.isascii() else raw
        low = plain(clear)
        toks = _TOKEN.findall(low)
        n_words += len(toks)
        # most sentences have no word of any list, no sign inside a word, no run of single letters and no stretched one
        odd = _ODD.search(low)
        if not odd and _TRIGGERS.isdisjoint(toks):
            continue
        hidden, gathered, obf = clear != raw, False, 0
        if odd:
            spaced = _SPACED.sub(_gather, low)
            gathered = spaced != low
            revealed = [reveal(t) for t in _TOKEN.findall(spaced)]
            toks, obf = [w for w, _ in revealed], sum(o for _, o in revealed)
        insult = slight = sexual = hate = sober = 0
        at, second = [], []
        for i, w in enumerate(toks):
            if w in _INSULT:
                insult += 1
                at.append(i)
            elif w in _SLIGHT:
                slight += 1
                at.append(i)
            elif w in _SECOND:
                second.append(i)
            if w in _SEXUAL:
                sexual += 1
                at.append(i)
            if w in _HATE:
                hate += 1
            if w in _SOBER:
                sober += 1
        attacks = [m[0] for m in _ATTACK.finditer(" ".join(toks))] if not _TRIGGERS.isdisjoint(toks) else []
        attack = len(attacks)
        near = sum(any(abs(i - j) <= 5 for j in second) for i in at) + sum(not _SECOND.isdisjoint(a.split()) for a in attacks)
        if (hidden or gathered) and at:
            obf += 1
        for k, v in zip(total, (insult, slight, sexual, hate if attack or at else 0, near, attack, obf, sober)):
            total[k] += v
        score = 3.0 * insult + 1.0 * slight + 1.0 * sexual + 3.0 * attack + (0.5 * near) + obf - 2.0 * sober
        if score > worst[0]:
            letters = sum(map(str.isalpha, raw))
            worst = (score, insult, near, attack, sum(map(str.isupper, raw)) / max(1, letters), len(_PUNCT.findall(raw)) / max(1, len(toks)), obf)
    per = 100.0 / max(n_words, 20)
    upper = len(_UPPER.findall(text))
    letters = len(text) or 1
    return [
        total["insult"] * per, total["slight"] * per, total["sexual"] * per, total["attack"] * per, total["hate"] * per, total["near"] * per, worst[0], float(worst[1]), float(worst[2]), float(worst[3]), worst[4], worst[5], total["obf"] * per, float(worst[6]),
        upper / letters, len(_PUNCT.findall(text)) * per, text.count("!") * per, total["sober"] * per, float(np.log1p(len(text))),
    ]


class Trees:
    """Boosted trees for 0/1 labels: logistic loss, splits of histograms, leaves shrunk by ``SHRINK``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, rate: float = RATE, shrink: float = SHRINK) -> None:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        for j, c in enumerate(self.cuts):  # a feature that is 0 nearly everywhere is still cut among the rest
            some = x[:, j][x[:, j] > 0]
            if len(some):
                self.cuts[j] = np.unique(np.concatenate([c, [0.0], np.quantile(some, np.linspace(0, 1, 17)[:-1])]))
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            tree, step = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6), depth, leaf, shrink)
            raw += rate * step
            self.trees.append(tree)
        self.rate = rate

    def _grow(self, binned, g, h, depth, leaf, shrink):
        """One tree as (feature, cut, left, right) nodes or leaf values, and its value for every row."""
        step = np.zeros(len(g))

        def node(rows: np.ndarray, level: int):
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, None, None)
            if level < depth and len(rows) >= 2 * leaf:
                for j in range(binned.shape[1]):
                    b, size = binned[rows, j], len(self.cuts[j]) + 1
                    n, gb, hb = np.bincount(b, minlength=size).cumsum(), np.bincount(b, g[rows], size).cumsum(), np.bincount(b, h[rows], size).cumsum()
                    fits = (n[:-1] >= leaf) & (len(rows) - n[:-1] >= leaf)
                    if fits.any():
                        gain = gb[:-1] ** 2 / (hb[:-1] + shrink) + (gs - gb[:-1]) ** 2 / (hs - hb[:-1] + shrink) - gs**2 / (hs + shrink)
                        gain[~fits] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, k)
            if best[1] is None:
                value = float(gs / (hs + shrink))
                step[rows] = value
                return value
            low = binned[rows, best[1]] <= best[2]
            return (best[1], float(self.cuts[best[1]][best[2]]), node(rows[low], level + 1), node(rows[~low], level + 1))

        return node(np.arange(len(g)), 0), step

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)

        def walk(tree, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if not isinstance(tree, tuple):
                out[rows] += self.rate * tree
                return
            low = x[rows, tree[0]] <= tree[1]
            walk(tree[2], rows[low])
            walk(tree[3], rows[~low])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: points (score, probability) to interpolate between."""
    order = np.argsort(score, kind="stable")
    x, first = np.unique(score[order], return_index=True)
    ones, n = np.add.reduceat(y[order], first), np.diff([*first, len(y)])
    blocks: list[list[float]] = []  # ones, cases, first and last score
    for s, o, m in zip(x, ones, n):
        blocks.append([float(o), float(m), s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o2, m2, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o2, blocks[-1][1] + m2, blocks[-1][2], end]
    at, p = [], []
    for o, m, lo, hi in blocks:
        at += [lo, hi] if hi > lo else [lo]
        p += [o / m] * (2 if hi > lo else 1)
    return np.array(at), np.array(p)


class Model:
    """Trees on all labels and the calibration learnt on cross-fold scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> None:
        self.share = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y.sum() < len(y):
            seen = np.zeros(len(y))
            for k in range(FOLDS):
                held = fold == k
                if held.any() and not held.all():
                    seen[held] = Trees(x[~held], y[~held]).raw(x[held])
            self.trees, self.curve = Trees(x, y), isotonic(seen, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), *self.curve) if self.trees else np.full(len(x), self.share)


def majority(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(doc_id, y): the label most reviewers gave; ties and nulls give none."""
    votes = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("m"))
    return votes.where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("double").alias("y"))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = ("source",), max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, keep..., score): the calibrated probability of every document.

    Null and empty texts score as a text without any hit. Rows with a null key give no row,
    repeated rows are scored repeatedly. Labels of documents not present, null labels and
    ties teach nothing; without labels of both kinds every score is the share of ones (0
    without any). An empty table gives an empty result.
    """
    chosen = majority(labels, key, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    kind = docs.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "f"])

    # at most max_labels rows of a few numbers are broadcast, and come back with their features
    known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    known = known.select("doc_id", "y", "text").mapInArrow(measure, f"doc_id {kind}, y double, f array<double>").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)))
    known = known.groupBy("doc_id").agg(F.min(F.struct("fold", "y", "f")).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.*").collect()
    x = np.array([r.f for r in known]).reshape(len(known), len(FEATURES))
    model = Model(x, np.array([r.y for r in known]), np.array([r.fold for r in known]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(model.score(f), pa.float64())], names=["doc_id", *keep, "score"])

    kept = [F.col(c).cast("string").alias(f"keep_{i}") for i, c in enumerate(keep)]
    schema = f"doc_id {kind}, " + "".join(f"`{c}` string, " for c in keep) + "score double"
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *kept).mapInArrow(run, schema)
