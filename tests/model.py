"""A plain per-node model of the assembly, for tests: two pointers, recursive walk."""

import math
from collections import defaultdict

ORDER = {c: i for i, c in enumerate("ACTG")}


def key(s):
    return [ORDER[c] for c in s]


def assemble(reads, k, coverage=1, buckets=1, limit=None, full_flow=False):
    """(partial contigs, walked contigs) of clean reads."""
    counts = defaultdict(int)
    for r in reads:
        for i in range(len(r) - k + 1):
            counts[r[i : i + k]] += 1
    cut = 1 if buckets <= 1 else min(range(1, buckets), key=lambda b: (sum(c == b for c in counts.values()), b))
    kept = sorted((x for x in counts if counts[x] >= cut), key=key)
    nodes = defaultdict(lambda: {"P": [], "S": []})
    for x in kept:
        visit = math.ceil(counts[x] / coverage)
        nodes[x[:-1]]["S"].append([x[-1], counts[x], visit, False])
        nodes[x[1:]]["P"].append([x[0], counts[x], visit, False])
    for n in nodes.values():
        n["P"].sort(key=lambda e: key(e[0]))
        n["S"].sort(key=lambda e: key(e[0]))
        p, s = (sum(e[2] for e in n[side]) for side in "PS")
        n["P"].append(["", 1, max(s - p, 0), True])
        n["S"].append(["", 1, max(p - s, 0), True])
    size = k - 1

    def wires(n):
        order = [sorted(range(len(n[side])), key=lambda i: (-n[side][i][2], -n[side][i][1], i)) for side in "PS"]
        left = {side: [e[2] for e in n[side]] for side in "PS"}
        out, tp, ts = [], 0, 0
        while sum(left["P"]):
            p, s = order[0][tp], order[1][ts]
            c = min(left["P"][p], left["S"][s])
            out.append((p, s, n["P"][p][2] - left["P"][p], n["S"][s][2] - left["S"][s], c))
            left["P"][p] -= c
            left["S"][s] -= c
            tp += not left["P"][p]
            ts += not left["S"][s]
        return out

    def before(node, seq):
        t = seq + node
        return t[:size], t[len(t) - len(seq) :]

    def after(node, seq):
        t = node + seq
        return t[len(t) - size :], t[: len(seq)]

    partial = []
    while limit is not None and len(nodes) > limit:
        chosen = []
        for name, n in nodes.items():
            near = [before(name, e[0])[0] for e in n["P"] if not e[3]] + [after(name, e[0])[0] for e in n["S"] if not e[3]]
            if all(key(x) <= key(name) for x in near):
                chosen.append(name)
        sent = []
        for name in sorted(chosen, key=key):
            n = nodes[name]
            for p, s, off_p, _, c in sorted(wires(n)[:], key=lambda w: (w[0], w[2])):
                pe, se = n["P"][p], n["S"][s]
                if pe[3] and se[3]:
                    partial.append(pe[0] + name + se[0])
                    continue
                (pred, pb), (succ, sb) = before(name, pe[0]), after(name, se[0])
                if not pe[3] and pred != name:
                    sent.append((pred, "S", pb, [pb + se[0], min(pe[1], se[1]), c, se[3] or succ == name]))
                if not se[3] and succ != name:
                    sent.append((succ, "P", sb, [pe[0] + sb, min(pe[1], se[1]), c, pe[3] or pred == name]))
        for name in chosen:
            del nodes[name]
        for target, side, search, new in sent:
            ext = nodes[target][side]
            at = next((i for i, e in enumerate(ext) if e[0] == search), None)
            if at is None or ext[at][3]:
                ext.append(new)
            else:
                ext[at] = new
    found = []

    def walk(seq, name, p, offset, freq):
        n, left = nodes[name], freq
        for pi, s, off, off_s, c in wires(n):
            if pi != p or left <= 0:
                continue
            if off + c <= offset or (off >= offset + freq if full_flow else off > offset + left):
                continue
            inside = max(offset - off, 0)
            take = min(left, c - inside)
            e = n["S"][s]
            if e[3]:
                found.append(seq + e[0])
            else:
                succ, back = after(name, e[0])
                q = next(i for i, x in enumerate(nodes[succ]["P"]) if x[0] == back and not x[3])
                walk(seq + e[0], succ, q, off_s + inside, take)
            left -= take

    for name in list(nodes):
        for i, e in enumerate(nodes[name]["P"]):
            if e[3] and e[2] > 0:
                walk(e[0] + name, name, i, 0, e[2])
    return sorted(partial), sorted(found)
