"""Labels of notices as written down by hand, and of notices with random edits."""

import random
import re

import pytest

from corvane.llm import licenses

from .conftest import prose

EXPECTED = {
    "SPDX-License-Identifier: GPL-2.0": "gpl-2",
    "SPDX-License-Identifier: GPL-2.0+": "gpl-2",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1",
    "SPDX-License-Identifier: 0BSD": "0bsd",
    "SPDX-License-Identifier: CC-BY-SA-3.0": "cc-by-sa",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit",
    "SPDX-License-Identifier: GPL-2.0-only OR BSD-3-Clause AND ISC": "bsd-3-clause,gpl-2,isc",
    "SPDX-License-Identifier: MIT or nothing": "mit",
    "SPDX-Licence-Identifier: MPL-2.0": "mpl-2",
    "licensed under a Creative Commons Attribution 3.0 Unported License": "cc-by",
    "licensed under the Creative Commons Attribution 4.0 International License": "cc-by",
    "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic License": "cc-by-nc-sa",
    "licensed under a Creative Commons Attribution-NoDerivatives 4.0 License": "cc-by-nd",
    "licensed under a Creative Commons Attribution 5.0 International License": "",
    "CC BY-ND 4.0": "",
    "licensed under CC BY-ND 4.0": "cc-by-nd",
    "CC BY 4.0": "",
    "CC BY": "",
    "Licensed under the GNU GPL v3": "gpl-3",
    "released under GPLv3.": "gpl-3",
    "Distributed under the GPL version 2": "gpl-2",
    "Licensed under the LGPL, version 2.1": "lgpl-2.1",
    "licensed under the GNU General Public License, version 2": "gpl-2",
    "licenced under the GNU General Public License version 3.0": "gpl-3",
    "licensed under the gnu general public license version 2 1": "",
    "licensed under the GNU Affero General Public License version 3": "agpl-3",
    "licensed under the GPL": "gpl",
    "licensed under the mozilla public license version 2 0": "mpl-2",
    "licensed under the mozilla public license version 2 0 1": "",
    "lcensed under th Mozilla Public License, version 1.1": "mpl-1.1",
    "Apache License, Version 1.1": "apache-1.1",
    "Apache License, Version 1.1.1": "",
    "licensed under the Apache License, Version 2.0": "apache-2",
    "released under the BSD 3-Clause License": "bsd-3-clause",
    "Released under the Eclipse Public License version 1.0": "epl-1",
    "under the mit licence": "",
    "unlicensed under the bsd license": "",
    "the mit of licensing": "",
    "gnu general purpose": "",
}


@pytest.mark.parametrize("text", EXPECTED)
def test_labels_by_hand(text):
    notices = licenses._compiled(tuple(licenses.ALL_NOTICES))
    for whole in (text, f"{prose(1, 8)} {text} {prose(2, 8)}", f"(({text}))"):
        assert licenses.judged(whole, notices)[5] == EXPECTED[text], whole


def test_edited_notices_are_found():
    """As many letters of a notice's free words as it allows are changed, at random."""
    notices, rng, missed = licenses._compiled(tuple(licenses.ALL_NOTICES)), random.Random(7), []
    for notice in rng.sample(notices, 150):
        sample = notice.template.replace("{version}", "{4 0}")
        free, inside = [], False
        letters = []
        for c in sample:
            if c in "{}":
                inside = c == "{"
                continue
            if not inside and c.isalpha():
                free.append(len(letters))
            letters.append(c)
        for k in rng.sample(free, min(len(free), notice.errors)):
            letters[k] = "q"
        text = f"{prose(3, 5)} {''.join(letters)} {prose(4, 5)}"
        if notice.label not in licenses.judged(text, notices)[5].split(","):
            missed.append(text)
        # and with as many more as a pattern cannot bear, nothing of the kind is left of long notices
        if len(free) > 60:
            for k in rng.sample(free, 40):
                letters[k] = "q"
            exact = f" {re.sub('[{}]', '', sample)} "
            assert notice.label not in licenses.judged(f"{prose(3, 5)} {''.join(letters)} {prose(4, 5)}", notices)[5].split(","), exact
    assert not missed
