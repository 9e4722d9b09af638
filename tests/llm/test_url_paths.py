"""Rule paths of one host: right verdicts, and no test of every rule."""

import random

from roadtrace.llm import url_trie as ut

rnd = random.Random(2)


class Counted(str):
    tests = 0

    def startswith(self, *a):
        Counted.tests += 1
        return super().startswith(*a)


def test_longest_path_of_many_without_a_scan():
    some = lambda: "/" + "/".join(rnd.choice(["", "a", "ab", "abc", "b", "b1"]) for _ in range(rnd.randint(0, 4)))
    rules = [ut.Rule(h, some(), rnd.choice(["allow", "block"])) for h in ("x.com", "com") for _ in range(120)]
    trie = ut.HostTrie(rules)
    for _ in range(3000):
        host, path = rnd.choice(["x.com", "y.x.com", "z.com", "net"]), rnd.choice(["", some()])
        want = None
        for h in ("com", "x.com"):
            fits = [r for r in rules if r.host == h and (host == h or host.endswith("." + h)) and path.startswith(r.path)]
            if fits:
                best = max(fits, key=lambda r: (len(r.path), r.path, r.verdict == "block"))
                want = (best.text, best.verdict)
        assert trie.match(host, path) == want
    wide = ut.HostTrie([ut.Rule("x.com", f"/{i}/", "block") for i in range(2000)])
    Counted.tests = 0
    assert wide.match("x.com", Counted("/1999/page")) == ("x.com/1999/", "block")
    assert wide.match("x.com", Counted("/nothing")) is None
    assert Counted.tests <= 20
