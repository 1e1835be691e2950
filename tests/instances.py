"""Instances for the command line and the solvers: drawn ones, and STP files of the folder that
SCORENET_INSTANCES names, whose kind is told by their rows."""

import glob
import os
import random
import re


def weighted(n, m, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(m)} | {(v, v + 1) for v in range(1, n)})
    weights = [round(rng.uniform(0, 6), 4) if rng.random() < 0.05 else round(-rng.uniform(0.1, 3), 4) for _ in range(n)]
    return "\n".join(["33D32945 STP File", "SECTION Graph", f"Nodes {n}", f"Edges {len(edges)}", *(f"E {u} {v}" for u, v in edges), "End", "SECTION Terminals", f"Terminals {n}", *(f"T {v} {w}" for v, w in enumerate(weights, 1)), "End", "EOF"])


def prizes(n, m, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(1, n + 1), 2))) for _ in range(m)} | {(v, v + 1) for v in range(1, n)})
    chosen = sorted(rng.sample(range(1, n + 1), n // 4))
    return "\n".join(["33D32945 STP File", "SECTION Graph", f"Nodes {n}", f"Edges {len(edges)}", *(f"E {u} {v} {rng.randint(5, 40)}" for u, v in edges), "End", "SECTION Terminals", f"Terminals {len(chosen)}", *(f"TP {v} {rng.randint(1, 120)}" for v in chosen), "End", "EOF"])


def given():
    """(kind, path) of each file of the folder."""
    out = []
    for path in sorted(glob.glob(f"{os.environ['SCORENET_INSTANCES']}/*.stp")) if "SCORENET_INSTANCES" in os.environ else []:
        with open(path) as f:
            out.append(("pcst" if "\nTP " in f.read() else "stp", path))
    return out


def parse_stp(text: str) -> dict:
    """{n, edges [(u, v, cost or None)], terminals {id: weight}, roots} of an STP file's text."""
    lines = [x.split() for x in re.split(r"\r\n|\r|\n", text)]
    if not text.startswith("33D32945"):
        raise ValueError("not an STP file")
    out: dict = {"n": None, "edges": [], "terminals": {}, "roots": []}
    m = t = None
    section = ""
    for w in lines:
        if not w:
            continue
        head = w[0].lower()
        if head == "section":
            section = w[1].lower()
        elif section == "graph" and head == "nodes":
            out["n"] = int(w[1])
        elif section == "graph" and head == "edges":
            m = int(w[1])
        elif section == "graph" and head == "e":
            u, v = int(w[1]), int(w[2])
            if not (1 <= u <= out["n"] and 1 <= v <= out["n"]):
                raise ValueError(f"edge {u} {v} names an unknown node")
            out["edges"].append((u, v, float(w[3]) if len(w) > 3 else None))
        elif section == "terminals" and head == "terminals":
            t = int(w[1])
        elif section == "terminals" and head in ("t", "tp"):
            out["terminals"][int(w[1])] = float(w[2])
        elif section == "terminals" and head == "rootp":
            out["roots"].append(int(w[1]))
    if m != len(out["edges"]) or t != len(out["terminals"]) + len(out["roots"]):
        raise ValueError("counts and rows differ")
    return out
