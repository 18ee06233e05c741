"""Licence phrases and public licence notices, as text."""

from __future__ import annotations

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
General Public License as published by the Free Software Foundation, either version {version} of the License, or
(at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""
_STATED = ("licensed under the {name}", "released under the {name}", "distributed under the {name}")


def _stated(*names: str) -> list[str]:
    return [form.format(name=name) for name in names for form in _STATED]


def _gnu(name: str, version: str) -> list[str]:
    return [_GNU.format(name=name, version=version), *_stated(f"GNU {name} General Public License, version {version}")]


def _creative_commons() -> dict[str, list[str]]:
    long = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    return {f"cc-{kind}-{version}": [
        f"licensed under CC {kind} {version}",
        f"licensed under a Creative Commons {'-'.join(long[x] for x in kind.split('-'))} {version} International License"]
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for version in ("3.0", "4.0")}


#: Label: texts and notices of the licence.
TEMPLATES = {
    "mit": [_MIT, *_stated("MIT License")],
    "isc": [_ISC, *_stated("ISC License")],
    "bsd-2-clause": [_BSD],
    "bsd-3-clause": [f"{_BSD} {_BSD_NAMES}", *_stated("BSD 3-Clause License")],
    "apache-2.0": [_APACHE, *_stated("Apache License, Version 2.0")],
    "gpl-2.0": _gnu("", "2"),
    "gpl-3.0": _gnu("", "3"),
    "lgpl-2.1": _gnu("Lesser", "2.1"),
    "lgpl-3.0": _gnu("Lesser", "3"),
    "agpl-3.0": _gnu("Affero", "3"),
    "mpl-2.0": [_MPL],
    "zlib": [_ZLIB],
    "unlicense": [_UNLICENSE],
    **_creative_commons(),
}
