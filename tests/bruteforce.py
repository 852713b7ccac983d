"""Plain-Python answers on small inputs, for operators SQL cannot check."""

from __future__ import annotations


def cyclic(edges: list[tuple]) -> set[frozenset]:
    """Strongly connected components with a cycle, by an iterative Tarjan walk."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, stack, found, count = {}, {}, set(), [], set(), 0
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = count
                    count += 1
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    comp = set()
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        comp.add(x)
                        if x == node:
                            break
                    if len(comp) > 1 or node in out[node]:
                        found.add(frozenset(comp))
    return found


def greedy_blocks(cells: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Rectangles (top, left, bottom, right) grown in reading order, right first and then down."""
    seen, blocks = set(), []
    for r, c in sorted(cells):
        if (r, c) in seen:
            continue
        right = c
        while (r, right + 1) in cells:
            right += 1
        bottom = r
        while all((bottom + 1, k) in cells for k in range(c, right + 1)):
            bottom += 1
        seen |= {(i, k) for i in range(r, bottom + 1) for k in range(c, right + 1)}
        blocks.append((r, c, bottom, right))
    return blocks
