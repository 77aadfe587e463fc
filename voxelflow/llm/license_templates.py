"""Licence templates: whole texts (the files beside this module), the notices that stand in file headers, one-line notices and tags.

A template's name is its licence, or the licence, a slash and the kind of notice.
"""

from __future__ import annotations

from pathlib import Path

_WARRANTY = (
    "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed " + _WARRANTY + " GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
_CC = "This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{url}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."

NOTICES = {
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0/header": _GNU.format(name="General Public License", v=2).replace("software: you", "software; you"),
    "GPL-3.0/header": _GNU.format(name="General Public License", v=3),
    "LGPL-2.1/header": _GNU.format(name="Lesser General Public License", v=2.1).replace("This program", "This library").replace("this program", "this library"),
    "LGPL-3.0/header": _GNU.format(name="Lesser General Public License", v=3),
    "AGPL-3.0/header": _GNU.format(name="Affero General Public License", v=3),
    "CC-BY-4.0/notice": _CC.format(name="Attribution", url="by"),
    "CC-BY-SA-4.0/notice": _CC.format(name="Attribution-ShareAlike", url="by-sa"),
    "CC-BY-NC-4.0/notice": _CC.format(name="Attribution-NonCommercial", url="by-nc"),
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT/line": "Released under the MIT License.",
} | {f"{name}/tag": f"SPDX-License-Identifier: {name}" for name in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense", "Zlib", "BSL-1.0")}


def default_templates() -> dict[str, str]:
    """Template texts by name."""
    return {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))} | NOTICES
