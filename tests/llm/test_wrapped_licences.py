import random
import textwrap

from tagloom.llm import licenses


def test_wrapped_notices_are_found(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(f"word{rng.randrange(400)}" for _ in range(rng.randrange(3, 60)))
    rows = [(i, "\n".join(prose() for _ in range(4))) for i in range(150)]
    families = ("gpl-2.0", "mit", "bsd-3-clause")
    wrapped = {900 + k: (f, textwrap.wrap(max(licenses.NOTICES[f], key=len), 74)) for k, f in enumerate(families)}
    for i, (_, own) in wrapped.items():
        rows.append((i, f"{prose()}\n\n" + "\n".join(own) + f"\n\n{prose()}"))
        rows.append((i + 50, f"{prose()}\n{prose()}\n" + "\n".join(" * " + x for x in own) + f"\n{prose()}"))
    rows += [(990, rows[-1][1]), (990, rows[-1][1])]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sure = sorted((r["doc_id"], r["family"]) for r in found if r["confirmed"])
    want = [(i + more, f) for i, (f, _) in wrapped.items() for more in (0, 50)]
    assert sure == sorted([*want, *[(990, "bsd-3-clause")] * 2])
    assert all(r["n_lines"] > 1 for r in found if r["confirmed"])
