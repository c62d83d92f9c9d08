"""Results stay whole where a line, an expression or a bucket is large."""

from __future__ import annotations

import numpy as np

from galena.llm import jaccard_join, license_scan
from galena.llm.common import mix


def test_long_licence_expressions_are_read_to_the_end_of_their_line():
    names = [f"licence-{i}" for i in range(1000)]
    for text, labels, permissive in (
        (" OR ".join([*names, "MIT"]), {*names, "mit"}, 1.0),
        (" AND ".join([*names, "AGPL-3.0"]), {*names, "agpl"}, 0.2),
        ("(" + " AND ".join(names) + ") OR MIT", {*names, "mit"}, 1.0),
        ("MIT" + " " * 3000 + "AND GPL-2.0", {"mit", "gpl"}, 0.3),
        (" OR ".join(names) + "\nOR MIT", {*names}, 0.5),
        ("(" * 5000 + "MIT" + ")" * 5000 + " AND GPL-2.0 -- a comment", {"mit", "gpl"}, 0.3),
    ):
        got = license_scan.scan(f"# SPDX-License-Identifier: {text}\n{{}}".encode())
        assert set(got[5].split(",")) == labels and got[7] == permissive and got[6] == 0.9


def test_recall_of_pairs_whose_buckets_are_split_at_every_level():
    """The runs as drawn, for pairs that share each coordinate with the probability of the threshold."""
    n, rng = 200_000, np.random.default_rng(0)
    shared = rng.random((n, jaccard_join.COORDINATES)) < jaccard_join.SIMILARITY
    value = rng.integers(0, 1 << 63, (n, jaccard_join.COORDINATES), dtype=np.uint64)
    found = np.zeros(n, bool)
    for run in range(jaccard_join.runs_for()):
        pair, node = np.arange(n), np.full(n, run, np.uint64)
        for _ in range(jaccard_join.DEPTH):
            first, second, both = jaccard_join.drawn(node)
            at = np.concatenate([np.arange(len(pair)), np.flatnonzero(both)])
            c = np.concatenate([first, second[both]])
            keep = shared[pair[at], c.astype(np.int64)]
            at, c = at[keep], c[keep]
            pair, node = pair[at], mix(mix(node[at] + jaccard_join.ROW) + value[pair[at], c.astype(np.int64)] + c)
        found[pair] = True
    assert (~found).mean() < 1 - jaccard_join.RECALL


def test_tags_in_any_case():
    for tag in ("SPDX-License-Identifier:", "spdx-license-identifier:", "SPdx-License-Identifier:", "spDX-LICENSE-identifier:"):
        assert license_scan.scan(f"{tag} MIT".encode())[5] == "mit"
