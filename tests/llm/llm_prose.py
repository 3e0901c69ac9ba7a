"""Random plain prose."""

WORDS = ["the", "of", "river", "stone", "tree", "lamp", "paper", "cloud", "green", "walks", "under", "seven", "bridge", "night", "quiet", "letter"]


def prose(r, n):
    out = []
    for i in range(n):
        w = r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.6 else "")
        out.append(w + (". " if i % 11 == 10 else " "))
    return "".join(out).strip()
