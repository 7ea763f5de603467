import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markwright.functions import ed25519, prf, stats, text
from markwright.operators import generate, transport
from markwright.operators.config import EXAMPLE_KEY, MarkConfig
from markwright.operators.generate import drawn, shaped

WRAP = (1 << 64) - 1


def slow_mix(x):
    z = (x + prf.GOLDEN) & WRAP
    z = ((z ^ (z >> 30)) * prf.MULTIPLY_1) & WRAP
    z = ((z ^ (z >> 27)) * prf.MULTIPLY_2) & WRAP
    return z ^ (z >> 31)


def test_mixer_is_bit_exact(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(64), rng.randrange(2**20)) for _ in range(500)] + [(0, 0), (WRAP, 0), (WRAP, 2**20 - 1)]
    df = spark.createDataFrame([(s >> 32, s & 0xFFFFFFFF, i) for s, i in rows], "s_h long, s_l long, i long")
    out = prf.mixed(df, "s", F.col("i"), "m").select("m_h", "m_l", prf.modulo("m", 12345).alias("r"), prf.uniform("m").alias("u")).collect()
    for (s, i), r in zip(rows, out, strict=True):
        z = slow_mix(s ^ i)
        assert (r["m_h"] << 32 | r["m_l"]) == z and r["r"] == z % 12345 and r["u"] == ((z >> 11) + 0.5) * 2.0**-53
        assert int(prf.np_mix(np.array([s], np.uint64) ^ np.uint64(i))[0]) == z


def test_hmac_and_seeds(spark):
    # RFC 4231, test case 2 uses a short key; case 1 has 20 bytes
    assert hmac.digest(b"\x0b" * 20, b"Hi There", "sha256").hex() == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    one = spark.range(1)
    for key in (b"\x0b" * 20, b"k" * 64, b"k" * 131):
        assert one.select(prf.hmac_sha256(key, F.lit(b"Hi There"))).first()[0] == hmac.new(key, b"Hi There", "sha256").hexdigest()
    df = prf.with_seeds(one.select(prf.hmac_sha256(EXAMPLE_KEY, prf.context_message([F.lit(1), F.lit(70000), F.lit(3)])).alias("d")), "d").first()
    expected = prf.np_seeds(EXAMPLE_KEY, (1, 70000, 3))
    assert all(df[f"{s}_h"] << 32 | df[f"{s}_l"] == int(expected[s]) for s in prf.SEEDS)
    with pytest.raises(ValueError):
        prf.check_key(b"short")


def test_uniforms_are_uniform():
    u = np.sort(prf.np_uniform(prf.np_mix(np.arange(5000, dtype=np.uint64) ^ np.uint64(99))))
    assert np.abs(u - (np.arange(5000) + 0.5) / 5000).max() < 1.63 / math.sqrt(5000)


def test_ed25519_vectors():
    # RFC 8032, section 7.1, tests 1 and 2
    for secret, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        s, m = bytes.fromhex(secret), bytes.fromhex(message)
        assert ed25519.public_key(s).hex() == public and ed25519.sign(s, m).hex() == signature
        assert ed25519.verify(bytes.fromhex(public), m, bytes.fromhex(signature))
        assert not ed25519.verify(bytes.fromhex(public), m + b"x", bytes.fromhex(signature))
    assert ed25519.read_private_pem(ed25519.private_pem(s)) == s and "PUBLIC KEY" in ed25519.public_pem(ed25519.public_key(s))


def test_ed25519_takes_multiples_from_tables(monkeypatch):
    secret, p, order = bytes(range(32)), ed25519.P, ed25519.ORDER
    for k in (0, 1, 255, 256, order - 1, 2**256 - 1, 3**150):
        assert ed25519._pack(ed25519._multiple(k, ed25519._base_table())) == ed25519._pack(ed25519._times(k, ed25519.BASE))
    public, signature = ed25519.public_key(secret), ed25519.sign(secret, b"m")
    assert ed25519.verify(public, b"m", signature)
    monkeypatch.setattr(ed25519, "_times", None)  # no multiple is worked out bit by bit for a key that was seen
    monkeypatch.setattr(ed25519, "_add", None)
    for i in range(20):
        message = bytes([i]) * i
        signature = ed25519.sign(secret, message)
        assert ed25519.verify(public, message, signature) and not ed25519.verify(public, message + b"x", signature)
        late = int.from_bytes(signature[32:], "little") + order
        assert not ed25519.verify(public, message, signature[:32] + late.to_bytes(32, "little"))
    monkeypatch.undo()
    one, other = (1).to_bytes(32, "little"), (p + 1).to_bytes(32, "little")  # the neutral point, and bytes that only reduce to it
    assert ed25519.verify(one, b"m", one + bytes(32)) and not ed25519.verify(one, b"m", other + bytes(32)) and not ed25519.verify(other, b"m", one + bytes(32))


def erlang(s, n):
    return sum(math.exp(-s + k * math.log(s) - math.lgamma(k + 1)) for k in range(n)) if s > 0 else 1.0


def test_gamma_tail(spark):
    rows = [(s, n) for n in (1, 2, 10, 57, 400, 7000) for s in (0.0, 0.01, n * 0.5, n * 0.9, n * 1.0, n * 1.1, n * 1.5 + 3)]
    df = spark.createDataFrame(rows, "s double, n int").select("s", "n", stats.gamma_tail(F.col("s"), F.col("n")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(erlang(r["s"], r["n"]), rel=1e-8, abs=1e-12), r
        assert stats._tail(r["s"], r["n"]) == pytest.approx(erlang(r["s"], r["n"]), rel=1e-8, abs=1e-12)
    assert spark.range(1).select(stats.gamma_tail(F.lit(12.0), F.lit(10))).first()[0] == pytest.approx(0.242392161670512, rel=1e-12)
    for n in (1, 3, 40, 700):
        assert stats._tail(stats.gamma_quantile(0.99, n), n) == pytest.approx(0.01, rel=1e-8)


def scores(spark, pos, neg):
    return spark.createDataFrame([(float(x), True) for x in pos] + [(float(x), False) for x in neg], "s double, p boolean")


def test_auc_roc_threshold(spark):
    df = scores(spark, [1, 2], [1, 0])
    assert stats.auc(df, "s", "p").first()["auc"] == 0.875
    assert stats.auc(df.where("p"), "s", "p").first()["auc"] is None
    assert sorted(map(tuple, stats.roc(df, "s", "p").collect()))[-1] == (math.inf, 0.0, 0.0)
    assert {(r["threshold"], r["fpr"], r["tpr"]) for r in stats.roc(df, "s", "p").collect()} == {(0.0, 1.0, 1.0), (1.0, 0.5, 1.0), (2.0, 0.0, 0.5), (math.inf, 0.0, 0.0)}
    for n in (60, 100):
        assert stats.empirical_threshold(scores(spark, range(n), []), "s", 0.01).first()[0] == n - 1
    assert stats.empirical_threshold(scores(spark, range(200), []), "s", 0.05).first()[0] == 190
    assert stats.empirical_threshold(scores(spark, [], []), "s", 0.01).first()[0] == math.inf


def test_iou(spark):
    rows = spark.createDataFrame([(0, 10, 5, 15), (0, 5, 10, 15), (0, 0, 0, 0)], "a int, b int, c int, d int")
    found = [r[0] for r in rows.select(stats.iou(*map(F.col, "abcd"))).collect()]
    assert found == [pytest.approx(1 / 3), 0.0, 0.0]


def test_text_functions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]

    assert one(text.tokenize, "it's ok. don’t é") == ["it's", "ok", ".", "don", "’", "t", "é"]
    assert one(text.tokenize, "a b　c\x1fd\x85e") == list("abcde")
    assert one(text.canonicalize, "​ﬁne  “x”…\t\ty\n \n\nz  ") == 'fine "x"... y\nz'
    assert one(text.canonicalize, "р­а") == "pa"
    split = lambda c: text.split_sentences(c)
    assert one(split, "") == [] and one(split, "Hi.") == ["Hi."]
    assert one(split, "First one here. Second one here! no split. (Third) is it?") == ["First one here.", "Second one here! no split.", "(Third) is it?"]
    long = " ".join(["wordy"] * 130)
    assert [len(s.split()) for s in one(split, long)] == [60, 60, 10]
    tokens = lambda c: text.detokenize(text.tokenize(c))
    # an opening mark that took a space itself does not bind what follows; a closing quote does
    for before, after in (('He said "yes, no" (maybe) it\'s.', 'He said " yes, no"(maybe) it\'s.'), ("a b, c; d!", "a b, c; d!"), ('x "y" z', 'x " y"z'), ("([a", "([a")):
        assert one(tokens, before) == after
    assert one(text.canonicalize, None) is None


def test_message_and_hash(spark):
    row = spark.range(1).select(text.canonical_hash(F.lit("abc")).alias("h"), text.message(F.lit("h"), F.lit("m"), F.lit("c")).alias("m")).first()
    assert row["h"] == hashlib.sha256(b"abc").hexdigest() and row["m"] == f"{text.DOMAIN}|h|m|c"


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 4), st.integers(2, 24), st.integers(2, 12), st.integers(0, 10_000), st.floats(0.05, 0.9))
def test_transport_keeps_marginals(contexts, blocks, columns, seed, beta):
    rng = np.random.default_rng(seed)
    rho = rng.dirichlet(np.full(blocks, 0.5), contexts)
    found = transport.couple(rho, rng.standard_normal((contexts, blocks, columns)), np.full(contexts, 5.0), beta)
    assert np.allclose(found.table.sum(axis=2), rho, atol=1e-9) and np.allclose(found.table.sum(axis=1), 1 / columns, atol=1e-9)
    assert (found.table >= 0).all()


def test_the_budget_is_met_by_each_context_of_a_batch():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(500, 0.3), 6)
    contexts = [(i, i + 1, i + 2) for i in range(6)]
    _, mass, cost, _ = generate.problems(p, contexts, EXAMPLE_KEY, MarkConfig())
    total = transport.entropies(p)
    found = transport.couple(mass, cost, total, 0.3, 0.01, 80)
    assert (np.abs(found.achieved - 0.3) < 0.011).all() and set(found.status) == {transport.ON_TARGET}
    assert transport.informations(found.table) == pytest.approx(found.achieved * total)
    one = transport.couple(mass[2:3], cost[2:3], total[2:3], 0.3, 0.01, 80)
    assert np.allclose(one.table[0], found.table[2], atol=1e-9)


def test_zero_budget_is_independent():
    rho = np.array([[0.5, 0.3, 0.2]])
    for beta, entropy in ((0.0, 1.0), (0.5, 0.0)):
        found = transport.couple(rho, np.zeros((1, 3, 4)), np.array([entropy]), beta)
        assert found.status[0] == transport.INDEPENDENT and np.allclose(found.table[0], np.outer(rho[0], np.full(4, 0.25)))


def test_marking_is_unbiased_over_columns():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(2000, 0.2))[None, :]
    config = MarkConfig()
    block, mass, cost, column = generate.problems(p, [(10, 20, 30)], EXAMPLE_KEY, config)
    found = transport.couple(mass, cost, transport.entropies(p), config.beta)
    lift = np.divide(found.table[0] * config.n_columns, mass[0][:, None], out=np.zeros_like(found.table[0]), where=mass[0][:, None] > 0)
    every = p * lift.T[:, block[0]]
    assert np.allclose(every.sum(axis=1), 1, atol=1e-9) and np.allclose(every.mean(axis=0), p[0], atol=1e-9)
    # the entropy that a column takes away is the coupling's information
    assert transport.entropies(p)[0] - transport.entropies(every).mean() == pytest.approx(transport.informations(found.table)[0], abs=1e-6)
    q, told = generate.marked(p, [(10, 20, 30)], np.zeros(1, bool), EXAMPLE_KEY, config)
    assert told.column[0] == column[0] and np.allclose(q[0], every[column[0]], atol=1e-9)
    for contexts, plain in (([()], [False]), ([(1, 2)], [True])):
        q, told = generate.marked(p, contexts, np.array(plain), EXAMPLE_KEY, config)
        assert told.column[0] == -1 and (q == p).all()


def test_temperature_and_top_p():
    p = np.array([[0.5, 0.3, 0.2], [0.2, 0.5, 0.3]])
    assert (shaped(p, top_p=0.5) > 0).sum(axis=1).tolist() == [1, 1] and (shaped(p, top_p=0.6) > 0).sum(axis=1).tolist() == [2, 2]
    assert shaped(p, 0.0, 0.1).tolist() == [[1, 0, 0], [0, 1, 0]]
    assert shaped(p, 2.0).max() < 0.5 and np.allclose(shaped(p, 2.0).sum(axis=1), 1)
    assert drawn(p, np.array([0.0, 0.999])).tolist() == [0, 2] and drawn(p, np.array([0.5, 0.1999])).tolist() == [1, 0]
