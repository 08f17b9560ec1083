"""Cross-validation of all models at once, and permutations without copies, against plain Python."""
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablemill import fixed
from tablemill.operators import learn
from tablemill.operators.store import stored
from test_runs import scores_by_hand

QUICK = {"Random Forest": {"numTrees": 5, "maxDepth": 3}, **{n: {"maxIter": 2} for n in ("XGBoost", "LightGBM", "CatBoost")}, "SVM (RBF)": {"maxIter": 10}}


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(4), []
    for i in range(240):
        x = [round(rng.random(), 3) for _ in fixed.FEATURES]
        good = x[0] + 0.3 * x[2] > 0.6
        out.append((f"p{i}", 0, *x, 1 if i % 6 else -1, "genuine" if good != (i % 17 == 0) else "no genuine"))
    names = ["page_id", "table_idx", *fixed.FEATURES, "consistency", "verification"]
    return stored(spark.createDataFrame(out, names), "rows")


def test_six_models_by_five_folds(rows, monkeypatch):
    held = {}
    scores = learn.fold_scores

    def kept(predicted, by):
        held["predicted"] = stored(predicted, "predicted")
        return scores(held["predicted"], by)
    monkeypatch.setattr(learn, "fold_scores", kept)
    got = {(r.model, r.fold): (r.f1_weighted, r.f1_macro, r.accuracy) for r in learn.cross_validate(rows, settings=QUICK).collect()}
    assert set(got) == {(m, k) for m in learn.MODELS for k in range(5)}
    pairs = defaultdict(list)
    for r in held["predicted"].collect():
        pairs[r.model, r.fold].append((r.verification, r.prediction))
        assert r.consistency == 1 or r.prediction == fixed.NOT_GENUINE_LABEL
    for key, said in pairs.items():
        assert got[key] == pytest.approx(scores_by_hand(said))
    assert sum(len(p) for (m, _), p in pairs.items() if m == "XGBoost") == 240
    means = {m: sum(got[m, k][2] for k in range(5)) / 5 for m in learn.MODELS}
    assert min(means.values()) > 0.6, means


def test_moves_are_bijections():
    for fold, k, repeat, a, b, n in learn.moves({0: 1, 1: 2, 2: 12, 3: 97}, 3):
        assert sorted((a * x + b) % n for x in range(n)) == list(range(n))
    assert len({m[3:5] for m in learn.moves({0: 1000}, 10)}) > 60


def test_values_move_as_said(rows):
    folded = learn.with_folds(rows, 3)
    tested = stored(folded.where("consistency = 1"), "tested")
    plain, ranks = {r.page_id: r for r in tested.collect()}, defaultdict(list)
    for r in plain.values():
        ranks[r.fold].append((hashlib.md5(f"{r.page_id}/0".encode()).hexdigest(), r.page_id))
    order = {fold: [p for _, p in sorted(ps)] for fold, ps in ranks.items()}
    want = {}
    for fold, k, repeat, a, b, n in learn.moves({f: len(o) for f, o in order.items()}, 2):
        for x, page in enumerate(order[fold]):
            want[order[fold][(a * x + b) % n], fixed.FEATURES[k], repeat] = plain[page][fixed.FEATURES[k]]
    got = learn.permuted(tested, 2)
    seen = got.collect()
    assert len(seen) == len(want) == 2 * len(fixed.FEATURES) * len(plain)
    for r in seen:
        assert r[r.feature] == want[r.page_id, r.feature, r.repeat]
        assert all(r[f] == plain[r.page_id][f] for f in fixed.FEATURES if f != r.feature)
        assert r.verification == plain[r.page_id].verification and r.fold == plain[r.page_id].fold


def test_importance_of_one_feature_by_hand(rows):
    got = {r.feature: r.importance for r in learn.permutation_importance(rows, "Logistic Regression", folds=2, repeats=2).collect()}
    folded = learn.with_folds(rows, 2)
    feature, drops = fixed.FEATURES[0], []
    moved = stored(learn.permuted(stored(folded.where("consistency = 1"), "t"), 2), "moved")
    for fold in range(2):
        model = learn.fit("Logistic Regression", stored(folded.where(F.col("fold") != fold), "rest"))

        def score(cases):
            return scores_by_hand([(r.verification, r.prediction) for r in model.predict(cases).collect()])[0]
        base = score(folded.where((F.col("fold") == fold) & (F.col("consistency") == 1)))
        drops.append(sum(base - score(moved.where((F.col("fold") == fold) & (F.col("feature") == feature) & (F.col("repeat") == k)))
                         for k in (1, 2)) / 2)
    assert got[feature] == pytest.approx(sum(drops) / 2) and got[feature] > 0.05
    assert set(got) == set(fixed.FEATURES)


def test_the_query_fits_every_model_with_all_its_trees(rows, monkeypatch):
    """200 trees of each preset, 15 levels of the forest: what reaches the fits, not only what is asked for."""
    from tablemill.operators import boosting
    from tablemill.plans import registry
    seen = []

    class Stop(Exception):
        pass

    def stages(name, taught, settings, made=learn._stages):
        if learn.MODELS[name] == "boosting":
            seen.append((name, settings.get("maxIter", boosting.ROUNDS)))
        elif name == "Random Forest":
            forest = made(name, taught, settings)[-1]
            seen.append((name, forest.getNumTrees(), forest.getMaxDepth()))
        else:
            seen.append((name, settings))
        raise Stop
    monkeypatch.setattr(learn, "_stages", stages)
    monkeypatch.setattr(registry, "learning_rows", lambda *_: rows)
    with pytest.raises(Stop):
        registry.QUERIES["cross_validation"](rows.sparkSession, "unread")
    assert {s[0] for s in seen} == set(learn.MODELS)
    assert set(seen[i][1:] for i in range(len(seen)) if learn.MODELS[seen[i][0]] == "boosting") == {(200,)}
    assert {s[1:] for s in seen if s[0] == "Random Forest"} == {(200, 15)}
    assert all(s[1] == {} for s in seen if learn.MODELS[s[0]] in ("rbf", "logistic"))
