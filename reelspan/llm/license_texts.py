"""The licences that a scan knows: label, text (or a usual notice), and the key phrase without which it does not count.

Fixed values, in lower case without punctuation: sentences that notices use, and operative parts of the licences' own texts.
"""

from __future__ import annotations

NOTICES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

TEXTS = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 3",
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        "gnu general public license as published by the free software foundation either version 2",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "gnu affero general public license as published by the free software foundation",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "source code form is subject to the terms of the mozilla public license",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
)

TEMPLATES = NOTICES + TEXTS
