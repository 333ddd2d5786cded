"""Canonical digests (licenses.digest) of the long texts in Debian's /usr/share/common-licenses, with and without what follows the end of their terms."""

# SPDX identifier without -only and -or-later, digest. A change of canonical() needs new ones.
DIGESTS = [
    ("Apache-2.0", "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e"),
    ("Apache-2.0", "b7bb6b2416cb5fc4e3acd34d1283c66e6228adab995f1c959405a3978193462c"),
    ("Apache-2.0", "cf7c26411074d941b42afe8baac32788531f003acea32d25ead49048c329c78d"),
    ("Artistic-1.0-Perl", "fe5e2754088225b53b69f1a45c4eecc5c71ab693ce0f9e07644ce6ceaed93d27"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "972be281081c29947d0bdf661acb7130e4dd0d2a9a142f2c39e263c2e0c4ca20"),
    ("GFDL-1.3", "be8ed4c290826d53c03cb156846cfdd4a30efc49ea81bb7ffa5bee025939cd0d"),
    ("GPL-1.0", "623616c29d1b130de555ac918949fb7b05b67711999871d9d8f68d4639e91089"),
    ("GPL-1.0", "91b305cf86edf86f06cf0d2e2fd9a19411380eed7bcaf9a3cfd5df4653d4fa22"),
    ("GPL-1.0", "a39d7cceab675e14bdc24e269448ac0ed44fdef25178b183064cd4b35b8d2e7b"),
    ("GPL-2.0", "41ba7b30f66484c3c9496407451675398b15ceaf26ae3739656f1e67a76307a3"),
    ("GPL-2.0", "9405dc2ae3fe08dea519d5874a1a44bb05d513336aed49976b5030bd5b8f27f6"),
    ("GPL-2.0", "d3a0c7eedaa425615460d9e7ed86b61b2472cc4ff3157a55ed36fb499c78ed2f"),
    ("GPL-3.0", "787617242a6fbeb05f515eedb22472f7b8ed493e4ce944e75733f9a4bc84427e"),
    ("GPL-3.0", "7c89b24347bb742d776924ad63350d6c7876cd9464ae5fc3502bec2109b5f836"),
    ("GPL-3.0", "a6f4adf410d5abf024b441465b523225db3613ecbf9562972cc60285e3cb376f"),
    ("LGPL-2.0", "10c0fcac03e41c6e467cc0747449e4bcf220faaabfc319d96d1b3a5ab8a4dd7c"),
    ("LGPL-2.0", "43056e963ed1b927908f558dfcf4f812f56c6be4630e8da88aa9bfc1660f6d09"),
    ("LGPL-2.0", "cda027fa77665ce4fef4be31ff00ece6993d9cad38c5cec3d188a88f30d0700b"),
    ("LGPL-2.1", "045e8054a0e84e3386fa254424f91424346ad391f2936e3a21e6324a50414391"),
    ("LGPL-2.1", "bd49bb08d28463dd11e4ead2a6e2d4c409ff3da7f72b27075e8d980e415d1040"),
    ("LGPL-2.1", "cefaac061e723e851d78a7256391c29edda0fe7ae144298a80e9671c3296ecc9"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]
