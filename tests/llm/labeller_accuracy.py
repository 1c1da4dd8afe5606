"""Share of invented held-out pages that op4 gets exactly right, with and without the vote of blocks of one path.

Run: python -m tests.llm.labeller_accuracy [pages]
"""

import sys

from binlore.llm import extract
from binlore.llm.pagegen import make_page


def main(pages: int = 2000) -> None:
    made = [make_page(2 * 10**7 + k) for k in range(pages)]  # seeds that training does not use
    weights, vectors = extract.load_weights(), extract.Vectors()
    found = [extract.blocks(h) for h, _ in made]
    scores = extract.label_pages(weights, [vectors.page(b) for b in found])
    for name, vote in (("network alone", lambda b, p: p), ("with the vote", extract.consensus)):
        right = sum("\n".join(b.text for b, q in zip(bs, vote(bs, p)) if q >= 0.5) == main if bs else not main for bs, p, (_, main) in zip(found, scores, made))
        print(f"{name}: {right} of {pages} pages exactly right")


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
