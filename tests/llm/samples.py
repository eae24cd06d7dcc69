"""Made-up rows with the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["key", "version", "rank", "score", "n_lines", "words", "fp", "component_id", "part", "salt", "length", "line", "keep"]


def prose(rng: random.Random, words: int, syllables: str = "ka lo mi ren tu sha ve") -> str:
    parts = syllables.split()
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(f"{w}.\n{w}" if k % 11 == 9 else w for k, w in enumerate(made))


def awkward() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    shared = "This Line is shared by several documents.\n"
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts = [None, "", " ", "\n\n", "one", "two words", *base]
    texts += [base[3], base[3], base[7] + " end", base[9].upper(), base[11].replace(" ", "  ")]
    texts += [shared + base[0], "  " + shared.lower() + base[1], shared + shared + base[2], base[4] + "\n" + shared]
    texts += ["<|endoftext|> it's ÉTÉ ﬁ 日本 x²", "a▁b ▁ c ", "tab\tand\x0bfeed\x0c", "x" * 5000, prose(rng, 9000)]
    return [(3 * k + 1, t) for k, t in enumerate(texts)]
