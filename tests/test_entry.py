import re

import __spark_entry__ as entry
from marginalia.plans import catalogue


def test_names():
    known = entry.queries()
    assert set(catalogue.oracle_sql()) <= set(known)
    assert not [n for n in catalogue.queries() if re.match(r"p\d", n)]
