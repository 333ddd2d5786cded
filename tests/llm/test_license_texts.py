import textwrap
from pathlib import Path

import pytest

from rasterloom.llm import licenses

FILES = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
FOLDER = Path("/usr/share/common-licenses")


def found(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [g.license for g in sorted(got, key=lambda g: g.doc_id)]


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence files here")
def test_unmodified_files(spark):
    assert found(spark, [(FOLDER / f).read_text() for f in FILES]) == list(FILES.values())


def test_titles(spark):
    mit, isc = (licenses.KNOWN[i][1] for i in (0, 1))
    wrapped = isc.replace("above copyright", "above\ncopyright").replace("copies.\n", "copies.\n\n")
    bsd = licenses.TITLED[3][1][0]
    texts = [
        "MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n".join(textwrap.fill(x, 78) for x in mit.split("\n")),
        "The MIT License (MIT)\n\n" + mit,
        "ISC License\n\nCopyright (c) 2020, Some One\n\n" + wrapped,
        "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + bsd,
        licenses.TITLED[2][1][1],
        "Some other title\n" + mit,
    ]
    assert found(spark, texts) == ["MIT", "MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", None]
