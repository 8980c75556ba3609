"""Licence notices that are wrapped, and notices of no template."""

import textwrap

from kinfold.llm import licences

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy and sell copies of the Software.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_wrapped_and_unlisted_notices(spark):
    prose = "Cats and dogs slept in the garden all day.\nRain fell on the old town for an hour."
    notices = [textwrap.fill(t, n) for t in (MIT, BSD, GPL) for n in (70, 76, 40)]
    notices += [textwrap.indent(textwrap.fill(GPL, 72), " * ")]
    rows = [(i, f"{prose}\n\n{t}\n\n{prose}", "c") for i, t in enumerate(notices)]
    rows += [(50, f"{prose}\nCopying and use of this program are subject to the Acme shareware licence.\n{prose}", "c"), (51, f"{prose}\n{prose}", "c")]
    rows += [(52, f"{prose}\nReleased under the MIT License.\n{prose}", "c")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect())
    families = ["mit"] * 3 + ["bsd"] * 3 + ["gpl-3.0"] * 4
    assert [r for r in got if r[2] != "unknown"] == [*[(i, 3, f) for i, f in enumerate(families)], (52, 2, "mit")]
    assert (50, 2, "unknown") in got and 51 not in {r[0] for r in got}
