"""The model in plain Python, one session at a time, to check the Spark jobs against.

It follows the context token by token where that is feasible: a ramp is walked up piece by piece, and
bills add up call by call or piece by piece instead of by closed forms.
"""

FRESH, GENERATED, WRITTEN, READ = 4.75e-6, 23.75e-6, 4.75e-6 * 1.25, 4.75e-6 * 0.10
FIELDS = ("session_id", "agent", "input_tokens", "output_tokens", "cache_creation_tokens",
          "cache_read_tokens", "api_call_count")


def work(s):
    dollars = 0.0
    for field, price in (("input_tokens", FRESH), ("output_tokens", GENERATED),
                         ("cache_creation_tokens", WRITTEN)):
        dollars += s[field] * price
    return dollars


def bill(s, read=None):
    return work(s) + (s["cache_read_tokens"] if read is None else read) * READ


def peak(s):
    """The top of a triangle with a base of all calls and an area of all cache reads."""
    calls, area = s["api_call_count"], s["cache_read_tokens"]
    if calls <= 0 or area <= 0:
        return None
    return area / (calls / 2)


def walked(top, threshold):
    """(from, to) of each piece on the way up to ``top``."""
    edges, at = [], 0
    while at + threshold < top:
        edges.append((at, at + threshold))
        at += threshold
    edges.append((at, top))
    return edges


def summary_bill(m, summary):
    """What a piece of ``m`` calls pays for its summary: made, stored, and read by later calls."""
    later = m - 1 if m > 1 else 0.0
    return summary * GENERATED, summary * WRITTEN, later * summary * READ


def ramp(s, edges, top, summary):
    """Rows (cost, calls, height, summary parts) of a session whose context restarts at each edge."""
    rows = []
    calls_per_token = s["api_call_count"] / top
    for low, high in edges:
        height = high - low
        m = calls_per_token * height
        # A call at height h reads h tokens: the mean over the piece is half its height.
        own = bill(s, 0) * (m / s["api_call_count"]) + m * (height / 2) * READ
        parts = summary_bill(m, summary) if rows else (0.0, 0.0, 0.0)
        rows.append((own + sum(parts), m, height, parts))
    return rows


def price_pieces(s, pieces, top, summary):
    """Cost and overhead of a session cut into pieces of the given heights, with a given peak."""
    at, edges = 0.0, []
    for height in pieces:
        edges.append((at, at + height))
        at += height
    rows = ramp(s, edges, top, summary)
    return sum(r[0] for r in rows), sum(sum(r[3]) for r in rows)


def _cut(s, threshold, alpha):
    top = peak(s)
    if top is None or not top > threshold:
        return None
    return ramp(s, walked(top, threshold), top, alpha * threshold)


def split(s, threshold, alpha):
    rows = _cut(s, threshold, alpha)
    if rows is None:
        return {"k": 1, "split_cost": bill(s), "oh": (0.0, 0.0, 0.0)}
    return {"k": len(rows), "split_cost": sum(r[0] for r in rows),
            "oh": tuple(sum(r[3][i] for r in rows) for i in range(3))}


def pieces(s, threshold, alpha):
    """Cost, calls and height of each piece."""
    rows = _cut(s, threshold, alpha)
    if rows is None:
        return [(bill(s), float(s["api_call_count"]), peak(s))]
    return [row[:3] for row in rows]


def at_rank(values, p):
    """The smallest value that more than the wanted share of all values don't exceed."""
    wanted = int(p / 100 * len(values))
    for candidate in sorted(set(values)):
        if sum(v <= candidate for v in values) > wanted:
            return candidate
    return max(values)
