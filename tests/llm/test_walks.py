import numpy as np

from lattika.llm import decontaminate, kernels


def test_walks_keyed_backwards_take_the_words_of_plain_walks():
    """Two starts have one key exactly if a plain walk samples the same words from both; parts meet without a seam."""
    rng = np.random.default_rng(3)
    vocab = rng.integers(1, 1 << 62, 6).astype(np.uint64)
    n = 2 * decontaminate.PART + 50
    for steps in (np.array([0, 3, 4, 9]), np.array([2, 11]), np.array([0])):
        words = np.concatenate((vocab[rng.integers(0, 6, n)], np.zeros(int(steps[-1]) + 1, np.uint64)))
        bits = kernels.mixed(words ^ kernels.random_words(1, 7))

        def plain(at):
            seen = []
            for t in range(int(steps[-1]) + 1):
                if t in steps:
                    seen.append(int(words[at]))
                at += int(bits[at]) >> t & 1
            return tuple(seen)

        start = np.concatenate((np.arange(n - 300, n), rng.integers(0, n, 2000), decontaminate.PART + np.arange(-20, 20)))
        keys = decontaminate.sampled(words, start, steps, 7).tolist()
        pairs = set(zip(keys, [plain(int(i)) for i in start], strict=True))
        assert len(pairs) == len({k for k, _ in pairs}) == len({p for _, p in pairs})
