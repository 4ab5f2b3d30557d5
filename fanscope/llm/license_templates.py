"""Notices and short texts of public licences, by name, and the phrases that carry the name."""

# The wording of the licences' own notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."),
    "lgpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    "agpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    "gpl-2": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions"),
}

# Of each template, the phrases that make it this licence and no other. They must be
# matched word by word, without a word between; where a template has none, its whole wording counts.
NAMED = {
    "mit-notice": ("the MIT License",),
    "mit-licensed": ("the MIT License",),
    "apache-2.0-notice": ("Apache License, Version 2.0",),
    "apache-2.0": ("Apache License, Version 2.0",),
    "gpl-3-notice": ("GNU General Public License, version 3",),
    "gpl-2-notice": ("GNU General Public License, version 2",),
    "gpl-3": ("GNU General Public License", "version 3 of"),
    "gpl-2": ("GNU General Public License", "version 2 of"),
    "lgpl-2.1": ("GNU Lesser General Public License", "version 2.1 of"),
    "lgpl-3": ("GNU Lesser General Public License", "version 3 of"),
    "agpl-3": ("GNU Affero General Public License", "version 3 of"),
    "bsd-3-clause": ("Neither the name of", "endorse or promote products"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0",),
    "cc0-1.0": ("to the public domain worldwide",),
    "boost-1.0": ("Boost Software License, Version 1.0",),
    "epl-2.0": ("Eclipse Public License 2.0",),
    "unlicense": ("released into the public domain",),
}

# The terms of Creative Commons licences and the scopes of their versions.
_CC_TERMS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
             "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
             "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}

# Each has a short notice and a long one, of the same form.
for _version, _scope in _CC_VERSIONS.items():
    for _kind, _terms in _CC_TERMS.items():
        _name = f"cc-{_kind}-{_version}"
        TEMPLATES[f"{_name}-notice"] = f"Licensed under CC {_kind.upper()} {_version}."
        NAMED[f"{_name}-notice"] = (f"CC {_kind} {_version}",)
        TEMPLATES[_name] = f"This work is licensed under a Creative Commons {_terms} {_version} {_scope} License."
        NAMED[_name] = (f"Creative Commons {_terms} {_version}",)
