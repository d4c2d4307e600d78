"""The trie of conversation prefixes against a trie made of plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

from marlpit.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, piece int, size int, leaves int, unit string, place int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 1, 1, "u", 1) for r in rows], SCHEMA).repartition(5)


def plain(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(x, key=lambda v: v[:4])] for c, x in turns.items()}
    # A node is known by its parent's number and its own turn, so that long paths cost no more than their turns.
    numbers, above, depth, last, members, ends = {}, [None], [0], [""], [[]], [[]]
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        at = 0
        members[0].append(c)
        for turn in own.get(int(c / 100) * 100, [])[:h] + own[c][h:]:
            if (at, turn) not in numbers:
                numbers[at, turn] = len(above)
                above.append(at), depth.append(depth[at] + 1), last.append(turn[1]), members.append([]), ends.append([])
            at = numbers[at, turn]
            members[at].append(c)
        ends[at].append(c)
    if not own:
        return []
    kids, leaves, saved = [0] * len(above), [0] * len(above), [0] * len(above)
    for k in range(len(above) - 1, -1, -1):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * len(last[k])
        if k:
            kids[above[k]] += 1
            leaves[above[k]] += leaves[k]
            saved[above[k]] += saved[k]
    digest_of = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(((min(members[k]), depth[k], min(members[above[k]]) if k else None, len(members[k]), kids[k], leaves[k], saved[k], digest_of(ends[k])) for k in range(len(above))), key=str)


def held(spark, rows):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(frame(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, 1, "user", "nobody"), (1, None, None, None), (1, 3, "user", "a"), (1, 3, "assistant", "z"), (1, 3, "user", "a"), (-5, 0, "user", "b"), (-105, 0, "user", "c"), (-105, 1, "user", "d"), (2, 0, "user", ""), (7, 5, "user", "Ünï 日本 \U0001f600"), (9, 2**40, "user", "late"), (9, -(2**40), "user", "early")]
    held(spark, rows)


def test_no_rows_and_one_row(spark):
    held(spark, [])
    held(spark, [(3, 0, "user", "one")])


def test_shared_beginnings_and_copies(spark):
    own = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", own.choice(["x", "yy", "zzz"])) for c in range(250) for t in range(own.randint(1, 7))]
    rows += [(c, t, "user", f"copied {t}") for c in range(1000, 1400) for t in range(9)]
    held(spark, rows)


def test_long_conversations_go_on_in_pieces(spark):
    """Lengths about the size of a piece and of two, copies of long paths that part late, ends of one inside another."""
    rows, own = [], random.Random(6)
    for c in range(100, 160):
        size = own.choice([58, 59, 60, 61, 62, 63, 64, 65, 66, 69, 120, 127, 128, 129, 130, 133, 134, 135, 200])
        part = own.choice([3, 60, 64, 65, 128, 180])
        rows += [(c, t, "user", f"turn {t}" if t < part else f"turn {t} {c % 3}") for t in range(size)]
    rows += [(c, t, "user", "same") for c in (300, 307, 311, 500) for t in range(64 * 2)]
    rows += [(9000, t, "user", f"own {t}") for t in range(3000)]
    held(spark, rows)
