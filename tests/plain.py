"""Plain forms of scores, letter by letter, to hold the vectorised ones against."""

from goldweave.functions.similarity import jaro_winkler_of


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def score(name: str, other: str, company: str, firm: str) -> float:
    names = 1 - distance(name, other) / max(len(name), len(other)) if name and other else 0.0
    return names * 0.6 + jaro_winkler_of(company, firm) * 0.4 if company and firm else names
