"""Licence notices to scan for."""

_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL": ("", ("1", "2")), "LGPL": ("Lesser ", ("2.1", "3")), "AGPL": ("Affero ", ("1", "3"))}
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""


def _gnu(name: str, kind: str, version: str) -> list[tuple[str, str, str]]:
    names = f"GNU {kind}General Public {version}"
    return [(name, f"This work is licensed under the GNU {kind}General Public License, version {version}.", names),
            (name, f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU
{kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at
your option) any later version.""", names)]


#: The wording of published notices, by SPDX name (NOASSERTION for a bare reservation of rights, LicenseRef for
#: a family without a version), and the words that name the licence where others have the same wording.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""", "Apache 2.0"),
    ("MIT", "Released under the MIT License.", "MIT"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "GNU General Public 3"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version.""", "GNU General Public 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met"""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "MPL 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("NOASSERTION", "All rights reserved."),
    *((f"Apache-{v}", f"Licensed under the Apache License, Version {v}.", f"Apache {v}") for v in ("1.0", "1.1")),
    *((f"MPL-{v}", f"Licensed under the Mozilla Public License, Version {v}.", f"Mozilla {v}") for v in ("1.0", "1.1", "2.0")),
    *((name, f"Released under the {kind} License.", kind) for name, kind in (
        ("MIT-0", "MIT-0"), ("ISC", "ISC"), ("LicenseRef-BSD", "BSD"), ("0BSD", "Zero-Clause BSD"), ("BSD-2-Clause", "BSD 2-Clause"),
        ("BSD-3-Clause", "BSD 3-Clause"), ("BSD-2-Clause", "2-Clause BSD"), ("BSD-3-Clause", "3-Clause BSD"))),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""", "endorse promote"),
    *(n for name, (kind, versions) in _GNU.items() for v in versions for n in _gnu(f"{name}-{v if '.' in v else v + '.0'}", kind, v)),
    *_gnu("LGPL-2.0", "Library ", "2"),
    *((f"LicenseRef-{name}", f"This work is licensed under the GNU {kind}General Public License.", f"GNU {kind}General Public")
      for name, (kind, _) in _GNU.items()),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.", f"CC {k} {v}") for k in _CC for v in ("4.0", "3.0", "2.5", "2.0", "1.0")
      if (k, v) != ("BY-NC", "4.0")),
    *((f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {long} {v} International License.",
       f"Creative Commons {long} {v}") for k, long in _CC.items() for v in ["4.0"]),
    ("CC0-1.0", "Licensed under CC0 1.0.", "CC0 1.0"),
]
