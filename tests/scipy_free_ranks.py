"""Average ranks by sorting, for comparison."""


def average_ranks(values):
    ordered = sorted(values)
    places = {}
    for place, v in enumerate(ordered, 1):
        places.setdefault(v, []).append(place)
    return {v: sum(p) / len(p) for v, p in places.items()}
