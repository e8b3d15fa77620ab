"""Top-N, mixtures, mixing and text quality against brute force, with nulls, ties, repeats and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from surfsphere.llm import gmm, mixing, quality, topn


def brute_top(rows, n):
    best = {}
    for r, c, p, s in rows:
        if None not in (r, c, p, s) and abs(s) < float("inf"):
            key = (r, c)
            best.setdefault(key, {})
            best[key][p] = min(s, best[key].get(p, s))
    return {(r, c, p, s, i + 1) for (r, c), d in best.items() for i, (s, p) in enumerate(sorted((s, p) for p, s in d.items())[:n])}


@pytest.mark.parametrize("n", [1, 3, 60, 100])
def test_top_n(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), f"p{rnd.randrange(400)}", rnd.choice([None, float("nan"), float("inf"), -float("inf"), -5.0, -5.0, -4.9, rnd.uniform(-900, 900)])) for _ in range(3000)]
    rows += [("hot", 0, f"p{i}", -5.0) for i in range(2000)]  # ties only
    rows += rows[:300]
    df = spark.createDataFrame(rows, "run_id string, cluster_id int, pose_id string, vina_score double").withColumns({"bin": F.lit(1), "salt": F.lit("x")})
    got = [tuple(r) for r in topn.best_poses(df, n).select("run_id", "cluster_id", "pose_id", "vina_score", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_top(rows, n)
    assert topn.best_poses(df.limit(0), n).count() == 0


def test_thresholds_work_for_any_n(spark):
    """One group of a million rows: the histogram cuts nearly all of them, also for many items and with copies."""
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), (F.col("id") % 200_000).alias("item"), (F.rand(3) * 100 - 100).alias("score"))
    for n in (3, 100, 400):
        r = topn.thresholds(rows, ["g"], "item", "score", n, 0.25).first()
        kept = rows.where(topn.score_bin(F.col("score"), 0.25) <= r["last_bin"])
        assert r["n_rows"] == 1_000_000 and n <= kept.select("item").distinct().count() <= 20 * n + 5000
        assert topn.top_n(rows, ["g"], "item", "score", n).count() == n


def sphere_run(rnd, run, sizes, spread=0.05):
    centres, out = [], []
    while len(centres) < len(sizes):
        c = rnd.normal(size=3)
        c /= np.linalg.norm(c)
        if all(c @ d < np.cos(0.7) for d in centres):
            centres.append(c)
    for k, (c, n) in enumerate(zip(centres, sizes)):
        u = c + rnd.normal(size=(n, 3)) * spread
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for v in u:
            own = int(rnd.integers(0, 5)) if rnd.random() < 0.1 else k
            out.append((run, f"p{len(out)}", float(np.arctan2(v[1], v[0]) + 2 * np.pi * rnd.integers(-1, 2)), float(np.arccos(v[2])), None if rnd.random() < 0.05 else own))
    return out


def brute_strays(rows):
    out = set()
    for run in {r[0] for r in rows}:
        mine = list({r[1]: r for r in rows if r[0] == run and r[2] is not None}.values())
        u = np.array([[np.sin(p) * np.cos(t), np.sin(p) * np.sin(t), np.cos(p)] for _, _, t, p, _ in mine])
        near = np.arccos(np.clip(u @ u.T, -1, 1)) <= np.radians(15)
        label = np.arange(len(mine))
        while True:
            new = np.array([label[near[i]].min() for i in range(len(mine))])
            if (new == label).all():
                break
            label = new
        for g in set(label):
            ids = [m[4] for m, x in zip(mine, label) if x == g and m[4] is not None]
            if ids:
                own = max(sorted(set(ids)), key=ids.count)
                out |= {(run, m[1]) for m, x in zip(mine, label) if x == g and m[4] not in (None, own)}
    return out


POSES = "run_id string, pose_id string, theta double, phi double, cluster_id int"


def test_strays_and_sites(spark):
    rnd = np.random.default_rng(11)
    rows = sphere_run(rnd, "a", [400, 60, 9, 1]) + sphere_run(rnd, "b", [3]) + sphere_run(rnd, "c", [1]) + sphere_run(rnd, "d", [90, 40, 30, 20, 20, 7])
    rows += [("a", "nowhere", None, None, 1), ("a", "nan", float("nan"), 1.0, 1)] + rows[:50]
    real = [r for r in rows if r[1] != "nan"]
    df = spark.createDataFrame(rows, POSES).withColumns({"site": F.lit("x"), "cell": F.lit(1.5)})
    got = [tuple(r) for r in gmm.strays(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_strays(real)
    s = gmm.sites(df).collect()
    assert sorted(r["n_poses"] for r in s if r["run_id"] == "a") == [1, 9, 60, 400]
    assert all(len(r["typical"]) == min(3, r["n_poses"]) for r in s)
    assert gmm.strays(df.limit(0)).count() == 0


def test_links_near_the_limit_are_decided_by_the_poses(spark):
    """Dense blobs whose edges are a hair under or over 15 degrees apart: cells alone can't tell."""
    rows = []
    for run, gap in (("under", 14.99), ("over", 15.01)):
        k = 0
        for start, own in ((0.0, 1), (2.0 + gap, 2)):
            for lon in np.linspace(start, start + 2.0, 40):
                for lat in np.linspace(-1, 1, 5) * (0.02 if lon in (2.0, 2.0 + gap) else 1):
                    rows.append((run, f"p{k}", float(np.radians(lon)), float(np.pi / 2 + np.radians(lat)), own if k % 7 else 3))
                    k += 1
    df = spark.createDataFrame(rows, POSES)
    assert {tuple(r) for r in gmm.strays(df).collect()} == brute_strays(rows)
    assert {r["run_id"]: r["count"] for r in gmm.sites(df).groupBy("run_id").count().collect()} == {"under": 1, "over": 2}


def test_mixture_finds_the_blobs():
    rnd = np.random.default_rng(0)
    c = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0]])
    u = np.repeat(c, 50, 0) + rnd.normal(size=(200, 3)) * 0.05
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    comp, density, slope, k = gmm.fit_mixtures(u[None], np.ones((1, 200)))
    assert k[0] == 4 and all(len(set(comp[0, i : i + 50])) == 1 for i in range(0, 200, 50))
    # The slope tells the density nearby: the log density of a hair aside, from a mixture of all cells there.
    i, aside = 10, np.array([1e-5, -2e-5, 1e-5])
    moved = u.copy()
    moved[i] += aside
    dens = gmm.fit_mixtures(moved[None], np.append(np.ones(200), [])[None])[1]
    assert abs(dens[0, i] - density[0, i] - slope[0, i] @ aside) < 0.2 * abs(slope[0, i] @ aside) + 1e-4
    middle = density[0, :50].argmax()
    assert u[middle] @ c[0] > 0.99


def test_the_mixture_gives_the_clusters():
    """Two blobs in a chain of neighbours: one site, but as many clusters as components; a component in two far places is two."""
    rnd = np.random.default_rng(3)
    lon = np.radians(np.concatenate([rnd.normal(0, 1.5, 200), rnd.normal(12, 1.5, 200), rnd.normal(120, 1.5, 50)]))
    lat = np.radians(rnd.normal(0, 1.5, 450))
    u = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    comp = np.append(gmm.fit_mixtures(u[None, :400], np.ones((1, 400)))[0][0], np.zeros(50, int))
    cluster, site, doubt = gmm.link_clusters(u, comp, np.ones(450))
    assert len(set(comp)) >= 2 and len(set(cluster)) == len(set(comp)) + 1 and len(set(site)) == 2 and not doubt
    assert len(set(site[:400])) == 1 and set(site[400:]).isdisjoint(site[:400])
    one, same, _ = gmm.link_clusters(u, np.zeros(450, int), np.ones(450))
    assert len(set(one)) == 2 and len(np.unique(np.stack([same, site]), axis=1).T) == 2  # the check makes the same sites of it


def test_em_goes_on_until_it_settles():
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(-1, 0.3, (300, 3)), rnd.normal(1, 0.3, (300, 3))])[None]
    q, w, dims = gmm._quadratic(x), np.ones((1, 600)), np.array([3])
    start = x[:, [0, 1]]
    dens = gmm._fit(q, w, dims, start)[1].mean()
    far = gmm._fit(q, w, dims, x[:, [0, 300]])[1].mean()
    assert abs(dens - far) < 0.02


def test_doubtful_cells_full_of_poses(spark):
    """Two cells with thousands of poses each, a hair beyond and within the limit: no join of all with all."""
    rnd = np.random.default_rng(6)
    rows = []
    for run, gap in (("over", 15.0004), ("under", 14.9996)):
        for k in range(6000):
            side, edge = k % 2, k < 4
            lon = (gap if side else 0.0) + (1 if side else -1) * (0.0 if edge else rnd.uniform(0.0001, 0.6))
            rows.append((run, f"p{k}", float(np.radians(lon)), float(np.pi / 2 + np.radians(0.0 if edge else rnd.uniform(-0.4, 0.4))), 1 + side))
    s = {r["run_id"]: r["count"] for r in gmm.sites(spark.createDataFrame(rows, POSES)).groupBy("run_id").count().collect()}
    assert s == {"over": 2, "under": 1}


def test_layers_of_many_repetitions():
    assert mixing.repetition_layers([]) == [] and mixing.repetition_layers([1]) == [(1, 1)]
    assert mixing.repetition_layers([3, 6]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 6)]
    layers = mixing.repetition_layers([1_000_000])
    assert layers[0] == (1, 1) and layers[-1][1] == 1_000_000 and len(layers) < 25 and all(a[1] + 1 == b[0] for a, b in zip(layers, layers[1:]))


def test_a_small_source_is_repeated_many_times(spark):
    docs = [(i, ["big"], 100) for i in range(2000)] + [(10_000 + i, ["tiny"], 7) for i in range(10)]
    d = spark.createDataFrame(docs, "doc_id bigint, sources array<string>, n_tokens bigint")
    t = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 100_000)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix_sources(d, t)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["tiny"]["mix_tokens"] - s["tiny"]["target_tokens"]) <= 70 and abs(s["big"]["mix_tokens"] - s["big"]["target_tokens"]) <= 200
    copies = [r["copies"] for r in uses.where("source = 'tiny'").collect()]
    assert max(copies) - min(copies) <= 1 and len(copies) == 10


def test_too_many_targets_are_an_error(spark):
    t = spark.range(mixing.MAX_PATTERNS + 5).select(F.col("id").cast("string").alias("source"), F.lit(0.0).alias("target_share"), F.lit(1).alias("max_repeats"))
    with pytest.raises(ValueError):
        mixing.mix_sources(spark.createDataFrame([], "doc_id bigint, sources array<string>, n_tokens bigint"), t)


def test_mixing(spark):
    rnd = random.Random(4)
    docs = [(i, rnd.choice([["big"], ["big"], ["big"], ["small"], ["small", "both"], ["other"], None, []]), rnd.choice([None, 0, 5, 10, 200])) for i in range(4000)]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("both", 0.1, 2), ("absent", 0.05, 9), ("null", None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, sources array<string>, n_tokens bigint").withColumn("pattern", F.lit("x"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix_sources(d, t)
    u, s = uses.collect(), {r["source"]: r for r in shares.collect()}
    total = sum(n or 0 for _, _, n in docs)
    assert {r["source"] for r in u} == {"big", "small", "both"}
    by = {i: (p, n) for i, p, n in docs}
    limit = {n: r for n, _, r in targets}
    for r in u:
        assert r["source"] in by[r["doc_id"]][0] and by[r["doc_id"]][1] == r["n_tokens"] > 0 and 1 <= r["copies"] <= limit[r["source"]]
    uses_of = {}
    for r in u:
        uses_of[r["doc_id"]] = uses_of.get(r["doc_id"], 0) + r["copies"]
    assert max(uses_of.values()) <= 3
    for name in ("big", "small", "both"):
        have = sum((n or 0) * limit[name] for _, p, n in docs if p and name in p)
        want = min(s[name]["target_tokens"], have)
        assert s[name]["target_tokens"] == round(s[name]["target_share"] * total) and abs(s[name]["mix_tokens"] - want) <= 200 * limit[name]
    assert s["absent"]["mix_tokens"] == 0 and s["absent"]["mix_share"] == 0.0
    assert sorted(map(tuple, mixing.mix_sources(d, t)[0].collect())) == sorted(map(tuple, u))
    assert mixing.mix_sources(d.limit(0), t)[1].count() == 5


def test_flow_prefers_fewer_repetitions():
    layers = {(0, 1): 100, (0, 2): 100, (1, 1): 50, (1, 2): 50}
    flow = mixing.min_cost_flow(layers, {"a": 120, "b": 60}, {(0, 1): ["a"], (0, 2): ["a"], (1, 1): ["a", "b"], (1, 2): ["a", "b"]})
    assert sum(flow.values()) == 180 and sum(v for k, v in flow.items() if k[1] == 1) == 150


SPEECH = ["Where did {} go?", "I don't know what you mean, {}.", "{} said we should leave.", "Give me the key, please.", "We have been here since dawn.", "No. Not like this.", "Are you still there, {}?", "- I told you not to wait."]
NAMES = ["Ann", "Bob", "Cleo", "Dan"]


def corpus():
    rnd = random.Random(2)

    def cues(lines):
        return "\n\n".join(f"{i + 1}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{x}" for i, x in enumerate(lines))

    docs, junk = [], set()
    for i in range(240):
        kind = i % 12
        n = rnd.randrange(12, 30)
        if kind == 0:
            lines = [f"{k}. {rnd.choice(['Bolt', 'Tin'])} {rnd.choice(['Rope', 'Wool'])} ({rnd.randrange(9)}:{rnd.randrange(10, 59)})" for k in range(n)]
        elif kind == 1:
            lines = ["|".join(f"{rnd.uniform(0, 900):.2f}" for _ in range(5)) for _ in range(n)]
        elif kind == 2:
            lines = [" ".join("".join(rnd.choice("bcdfgklmnprstvxz") + rnd.choice("aeiouy") for _ in range(rnd.randrange(1, 5))) for _ in range(6)) + "." for _ in range(n)]
        elif kind == 3:
            lines = ["".join(rnd.choice("~-_=*.") for _ in range(30)) for _ in range(n)]
        else:
            lines = [rnd.choice(SPEECH).format(rnd.choice(NAMES)) for _ in range(n)]
            lines = [x.upper() for x in lines] if kind == 4 else [f"♪ {x} ♪" for x in lines] if kind == 5 else lines
        if kind < 4:
            junk.add(i)
        docs.append((i, cues(lines) if i % 2 else "\r\n".join(lines)))
    return docs + [(900, None), (901, ""), (902, " \n\n "), (903, "1\n00:00:01,000 --> 00:00:02,000\n[door]\n"), (904, "word " * 40_000), (904, "word " * 40_000)], junk


def test_quality(spark):
    docs, junk = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_lines", F.lit("x"))
    found = {r["doc_id"] for r in quality.not_speech(df).collect()} - {904}
    assert found == junk
    rows = {r["doc_id"]: r for r in quality.document_quality(df).collect()}
    assert all(rows[i]["n_lines"] == 0 and rows[i]["prose_share"] is None for i in (900, 901, 902, 903))
    r = rows[11]
    assert r["n_lines"] > 10 and r["prose_share"] > 0.9 and 2 < r["mean_word_length"] < 6 and r["punctuated_share"] > 0.9
    assert rows[904]["n_lines"] == 1 and rows[904]["n_words"] == 40_000
    assert sum(rows[11][f"{k}_share"] for k in quality.KINDS) == pytest.approx(1.0)
    assert quality.not_speech(df.limit(0)).count() == 0 and quality.not_speech(df.where("doc_id >= 900 AND doc_id < 903")).count() == 0


def test_lexical_emissions_are_trained(spark):
    docs, _ = corpus()
    model = quality.fit(quality.parsed(spark.createDataFrame(docs, "doc_id bigint, text string")))
    for name in ("lexicon", "triples", "unknown"):
        i = list(quality.STATS).index(name)
        assert not np.allclose(model.emit[i], model.seed[i], atol=0.01), name
    assert np.allclose(model.emit.sum(2), 1)


def test_lines_without_triples_teach_nothing_about_triples():
    model, i = quality.Model(), list(quality.STATS).index("triples")
    model.know(*np.ones((5, 1), int))
    model.usual = 0.05
    counts = np.zeros((len(quality.STATS), 4, quality.WIDTH))
    counts[i, 1, :3] = [1e6, 300, 100]
    model.learn(counts, np.zeros((4, 4)))
    bare = quality.Model()
    bare.know(*np.ones((5, 1), int))
    bare.usual = 0.05
    counts[i, 1, 0] = 0
    bare.learn(counts, np.zeros((4, 4)))
    assert np.allclose(model.emit[i], bare.emit[i]) and model.emit[i, 1, 1] > 2 * model.emit[i, 1, 2] and np.allclose(model.emit[i].sum(1), 1)


def test_posteriors_equal_the_single_chain():
    rnd = np.random.default_rng(0)
    m = quality.Model()
    log_b, n = rnd.normal(size=(9, 4)), np.array([3, 0, 5, 1])
    gamma, moves = quality.posteriors(log_b, n, m)
    at = 0
    for k in n:
        if k:
            paths = np.array(np.meshgrid(*[range(4)] * k, indexing="ij")).reshape(k, -1).T
            w = np.log(m.start[paths[:, 0]]) + sum(log_b[at + t, paths[:, t]] for t in range(k)) + sum(np.log(m.move[paths[:, t], paths[:, t + 1]]) for t in range(k - 1))
            p = np.exp(w - w.max())
            p /= p.sum()
            for t in range(k):
                assert np.allclose([p[paths[:, t] == s].sum() for s in range(4)], gamma[at + t])
        at += k
    assert moves.sum() == pytest.approx(2 + 4)


def known(model, *lines):
    """Words, pairs and triples of the lines, each in 500 documents and seldom back."""
    chunk = quality.parse(["\n".join(lines)])
    keys = np.unique(np.concatenate([chunk.hashed, quality.triples_of(chunk)[0], quality.pairs_of(chunk)[0]]))
    counts = [np.full(len(keys), x) for x in (500, 500, 10_000, 100)]
    counts[1][chunk.hashed[0] == keys] = 5  # the rarest that is known
    model.know(keys, *counts)
    model.usual = 0.05


def test_triples_say_nothing_where_they_cannot_be_judged():
    model = quality.Model()
    known(model, "we will meet", "will meet again", "at", "noon", "the", "map")
    column = list(quality.STATS).index("triples")

    def triples(said):
        return model.bins(quality.parse([said]))[0, column]

    assert triples("we will meet again") == 5  # all common
    assert triples("we wiil meet agaln") == 0  # every triple has a misread word
    assert triples("we will meet again xq") == 5  # the spoilt triple doesn't count
    assert triples("noon the map at noon") == 1  # known words in no common order
    assert triples("we will") == 0
    bins = np.zeros((2, len(quality.STATS)), int)
    bins[1, column] = 1
    a, b = model.log_emissions(bins)
    assert not np.allclose(a - a[0], b - b[0])
    model.emit[column, :, 0] = [0.9, 0.1, 0.1, 0.1]
    assert np.allclose(model.log_emissions(bins)[0], a)


def test_counts_equal_brute_force():
    texts = ["a pinch of salt\na pinch of tin\nwhere is it\na pinch of tin", "a pinch of salt", None, "", "where is it\nis it so"]
    chunk = quality.parse(texts)
    sums = dict(zip(*(x.tolist() for x in quality.counts_of(chunk)[:1]), zip(*(x.tolist() for x in quality.counts_of(chunk)[1:]))))
    for words in (["pinch"], ["is"], ["a", "pinch"], ["a", "pinch", "of"], ["is", "it"], ["tin"]):
        of = quality.parse([" ".join(words)])
        key = of.hashed[0] if len(words) == 1 else (quality.pairs_of(of)[0][0] if len(words) == 2 else quality.triples_of(of)[0][0])
        docs = lines = pairs = back = 0
        for t in texts:
            mine = set((t or "").split("\n")) - {""}
            k = sum(f" {' '.join(words)} " in f" {x} " for x in mine)
            docs, lines, pairs, back = docs + (k > 0), lines + k, pairs + k * (len(mine) - 1), back + k * (k - 1)
        assert sums[int(key)] == (docs, lines, pairs, back), words


TALK = {
    "en": ["Where did {} go?", "I told you not to {v} {o} tonight.", "{} said we should {v} {o}.", "Give me {o}, please.", "I don't know what you mean.", "We'll meet before dawn.", "You can't {v} {o} without me, {}.", "Why would they want {o}?", "I think {} is late.", "It's too cold out here.", "Put {o} on the table and don't say a word.", "When I was young we had to {v} {o}."],
    "de": ["Wo ist {} hin?", "Ich habe dir gesagt, du sollst {o} nicht {v}.", "Wir treffen uns heute Nacht.", "Warum wollen sie {o} {v}?", "Das tut mir leid, wirklich.", "Es ist viel zu kalt hier draußen.", "Hast du {o} gesehen?", "Niemand geht vor dem Morgen, {}.", "Du kannst {o} nicht ohne mich {v}.", "Ich weiß nicht, was du meinst."],
    "ru": ["Куда пошёл {}?", "Я же говорил тебе не {v} {o}.", "Мы встретимся до рассвета.", "Ты видел {o}?", "Прости, мне правда жаль.", "Здесь слишком холодно сегодня.", "Нам надо {v} {o} снова.", "Никто не уйдёт отсюда ночью, {}.", "Ты не можешь {v} {o} без меня.", "Я не знаю, о чём ты."],
    "ja": ["{}はどこへ行った？", "{o}を見たか？", "何のことか分からない。", "夜明け前に、駅で会おう。", "ここは寒すぎる。", "一緒に{o}を直すしかない。", "どうして{o}を忘れるの？", "ごめん。本当にごめん。", "聞いてくれ、{}。", "今夜、{o}を返すなと言っただろう。"],
}
THINGS = {
    "en": ["the lantern", "the map", "my coat", "that key", "the money", "a letter", "the ledger"], "de": ["die Laterne", "die Karte", "meinen Mantel", "das Geld", "einen Brief", "den Schlüssel", "das Heft"],
    "ru": ["фонарь", "карту", "моё пальто", "этот ключ", "деньги", "письмо", "тетрадь"], "ja": ["ランタン", "地図", "帳簿", "その鍵", "お金", "手紙", "古い写真"],
}
DO = {"en": ["hide", "sell", "find", "forget"], "de": ["verstecken", "verkaufen", "finden", "vergessen"], "ru": ["спрятать", "продать", "найти", "забыть"], "ja": ["x"]}
CAST = {"en": "{} {} as {o}", "de": "{} {} als {o}", "ru": "{} {} — {o}", "ja": "{} {}：{o}"}
PEOPLE = ["Wenna", "Marlo", "Torvik", "Sable", "Junia", "Orrin", "Kavo", "Fenn", "Brenna"]


def test_lists_of_fluent_lines_in_several_languages(spark):
    """Casts, recipes, timetables and lists of things, with and without full stops, among and within prose."""
    rnd = random.Random(7)

    def talk(lang):
        parts = {"o": rnd.choice(THINGS[lang]), "v": rnd.choice(DO[lang])}
        return rnd.choice(TALK[lang]).format(*rnd.sample(PEOPLE, 2), **parts)

    def item(kind, lang, stop):
        if kind == 0:
            said = CAST[lang].format(*rnd.sample(PEOPLE, 2), o=rnd.choice(THINGS[lang]))
        elif kind == 1:
            said = ("、" if lang == "ja" else ", ").join(rnd.sample(THINGS[lang], rnd.randrange(2, 5))) + ("、" if lang == "ja" else ",")
            return said
        elif kind == 2:
            said = rnd.choice(["Two cups of {}", "A pinch of {}", "Half a bag of {}", "The rest of the {}"]).format(rnd.choice(["salt", "flour", "wool", "tin", "rope", "resin"])) + rnd.choice(["", ", sifted", ", cold", " for the top"])
        else:
            said = f"{rnd.choice(['Monday', 'Friday'])} {rnd.randrange(10, 24)}:{rnd.randrange(10, 60)} {rnd.choice(['Vellin', 'Lower Quay', 'Pier Nine'])} to {rnd.choice(['Karsholm', 'Brindle Point'])}, platform {rnd.randrange(9)}"
        return said + "." * stop

    docs, lists = [], set()
    for i in range(1200):
        lang = ("en", "en", "de", "ru", "ja")[i % 5]
        n = rnd.randrange(10, 40)
        share = 0.0
        if i % 8 == 0:
            share = rnd.choice([0.15, 0.85, 1.0])
            kind, stop = i // 8 % 4, rnd.randrange(2)
        lines = [item(kind, lang, stop) if k < share * n else talk(lang) for k in range(n)]
        rnd.shuffle(lines)
        docs.append((i, "\n".join(lines)))
        if share > 0.5:
            lists.add(i)
    found = {r["doc_id"] for r in quality.not_speech(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(lists) > 80 and found == lists


def test_digits_of_a_line_are_counted_once():
    """They were counted for the statistics and once more, sign by sign, for the line's signs."""
    c = quality.parse(["ab 12\nab ²٣ 1’x"])
    assert c.plain[:, :3].tolist() == [[2, 0, 5], [3, 1, 9]]  # letters, signs, length: other digits are no signs
    assert quality.statistics("ab 12", ["ab", "12"], "ab12", 4, 2, 2) == c.form[0].tolist()


def test_counts_do_not_sort_the_keys(monkeypatch):
    """Sorting every word, pair and triple of a chunk by its hash took as long as parsing the texts."""
    plain = np.unique
    monkeypatch.setattr(quality.np, "unique", lambda x, **more: pytest.fail("sorted") if more else plain(x))
    key, docs, lines, pairs, back = quality.counts_of(quality.parse(["red fox\nred hen", "red fox", None]))
    assert len(set(key.tolist())) == len(key)
    assert sorted(zip(docs.tolist(), lines.tolist(), pairs.tolist(), back.tolist()))[-1] == (2, 3, 2, 2)  # red
    assert len(quality.counts_of(quality.parse([None]))[0]) == 0
