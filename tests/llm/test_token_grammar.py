"""The grammar of a token shard: nothing frequent is left, whatever the symbols and however long the copies."""

from collections import Counter

import numpy as np

from litquarry.llm.token_output import Grammar, repair


def frequent(symbols):
    """Most places that a pair of symbols has, of which no two overlap."""
    places, last = Counter(), {}
    for k, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if last.get(pair, -2) < k - 1 or pair[0] != pair[1]:
            places[pair] += 1
            last[pair] = k
    return max(places.values(), default=0)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(1)
    long_copy = rng.integers(0, 5000, 3000)  # longer than 64 ids, of far more than 1,023 symbols
    copies = np.concatenate([np.append(long_copy, 5000 + k) for k in range(40)])
    for ids in (copies, rng.integers(0, 6, 9000), np.full(4000, 3), np.tile([1, 2, 2], 700), np.zeros(0, int), np.array([4])):
        symbols, rules = repair(ids.astype(np.uint32), 6000)
        assert np.array_equal(Grammar(6000, rules).expand(symbols), ids)
        assert frequent(symbols) < 16


def test_rules_run_out():
    ids = np.random.default_rng(2).integers(0, 50, 20000)
    symbols, rules = repair(ids.astype(np.uint32), 50, most_rules=7)
    assert len(rules) == 7 and np.array_equal(Grammar(50, rules).expand(symbols), ids)


def test_shards_with_more_symbols_than_sixteen_bits():
    """Rules go on beyond 65,535 symbols, and a shard then holds wider ones."""
    from litquarry.llm.token_output import Shard, shard_bytes

    ids = np.tile(np.array([1, 2, 3, 65_530]), 300)
    shard = Shard(shard_bytes([1], [len(ids)], ids.astype(np.uint32), 65_535))
    assert np.array_equal(shard.tokens(0, len(ids)), ids) and len(shard_bytes([1], [len(ids)], ids.astype(np.uint32), 65_535)) < 2 * len(ids)
