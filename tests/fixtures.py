"""Claim sentences and hand-computed goldens (see FIXTURES.md)."""

# Sentences of the reference's own tests and sample files.
T = [
    "Our company reduced carbon emissions by 25% through renewable energy initiatives.",
    "We are committed to sustainability and environmental protection.",
    "Green energy solutions implemented across all facilities.",
    "Carbon footprint reduction achieved through innovative technology.",
    "Environmental impact minimized through sustainable practices.",
    "We pledge to achieve net-zero emissions by 2030.",
    "Sustainability is at the core of our business strategy.",
    "Renewable energy adoption leads to significant cost savings.",
    "Green building standards implemented in all new constructions.",
    "Environmental responsibility drives our decision-making process.",
]
B = [
    "Our company has achieved 100% carbon neutrality through innovative renewable energy solutions.",
    "We are committed to sustainable practices and environmental stewardship.",
    "Our ESG initiatives have resulted in a 50% reduction in emissions while maintaining profitability.",
    "We pledge to achieve net-zero emissions by 2050 through comprehensive sustainability measures.",
    "Our company maintains the highest standards of corporate governance and ethical business practices.",
]
R = [
    "We achieved almost net-zero carbon emissions in 2024 across all global operations, without the need for "
    "carbon offsets or any operational changes.",
    "In 2023, we reduced Scope 1 and Scope 2 greenhouse gas emissions by 18% compared to our 2020 baseline, "
    "through facility energy retrofits and switching to certified renewable electricity",
]
A0 = "We achieved 100% carbon neutrality."
O = [
    "We guarantee a greener tomorrow.",
    "Our plan will always ensure zero emissions.",
    "By 2031 the plant cut water use 12 percent.",
    "This claim is unclear.",
    "Fully sustainable and committed: carbon neutral, net zero, 100% renewable.",
    "",
    "The best, most green, most sustainable, eco-friendly label: vague, misleading and exaggerated.",
    "Solar output rose 7 percent. " * 20,
]

SENTENCES = ([(f"T{i}", s) for i, s in enumerate(T)] + [(f"B{i}", s) for i, s in enumerate(B)]
             + [("R0", R[0]), ("R1", R[1]), ("A0", A0)] + [(f"O{i + 1}", s) for i, s in enumerate(O)])

# id: chars, words, H1, H2, n indicators, H4, (E, S, G, W), issues, H10a, H10b
GOLDEN = {
    "T0": (81, 11, 0.0, 0.0, 1, 0.1, (4, 0, 0, 0), 0, 0.24, 0.225),
    "T1": (64, 8, 0.0, 0.0, 1, 0.1, (0, 0, 0, 0), 1, 0.30, 0.285),
    "T2": (57, 7, 0.0, 0.0, 1, 0.1, (2, 0, 0, 0), 1, 0.30, 0.285),
    "T3": (66, 7, 0.0, 0.0, 1, 0.1, (1, 0, 0, 0), 1, 0.30, 0.285),
    "T4": (61, 6, 0.0, 0.0, 1, 0.1, (1, 0, 0, 0), 1, 0.30, 0.285),
    "T5": (48, 8, 0.0, 0.4, 1, 0.1, (1, 0, 0, 0), 0, 0.285, 0.27),
    "T6": (55, 9, 0.0, 0.0, 1, 0.1, (0, 0, 0, 0), 1, 0.30, 0.285),
    "T7": (60, 8, 0.0, 0.0, 2, 0.2, (2, 0, 0, 0), 1, 0.30, 0.285),
    "T8": (62, 8, 0.0, 0.0, 1, 0.1, (1, 0, 0, 0), 1, 0.30, 0.285),
    "T9": (64, 6, 0.0, 0.0, 1, 0.1, (0, 0, 0, 0), 1, 0.30, 0.285),
    "B0": (94, 12, 0.0, 0.6, 3, 0.5, (3, 0, 0, 0), 0, 0.24, 0.225),
    "B1": (72, 9, 0.0, 0.0, 2, 0.2, (1, 0, 0, 0), 1, 0.30, 0.285),
    "B2": (98, 14, 0.0, 0.0, 0, 0.0, (1, 0, 0, 0), 0, 0.24, 0.225),
    "B3": (94, 12, 0.0, 0.4, 1, 0.1, (1, 0, 0, 0), 0, 0.24, 0.225),
    "B4": (99, 13, 0.0, 0.0, 1, 0.1, (0, 0, 0, 0), 1, 0.30, 0.285),
    "R0": (146, 22, 0.0, 0.0, 1, 0.1, (2, 0, 0, 0), 0, 0.24, 0.225),
    "R1": (185, 29, 0.0, 0.0, 1, 0.1, (4, 0, 0, 0), 0, 0.24, 0.225),
    "A0": (35, 5, 0.0, 0.6, 2, 0.4, (1, 0, 0, 0), 0, 0.285, 0.27),
    "O1": (32, 5, 0.3, 0.2, 1, 0.1, (1, 0, 0, 0), 1, 0.335, 0.32),
    "O2": (43, 7, 0.5, 1.0, 1, 0.1, (1, 0, 0, 0), 1, 0.335, 0.32),
    "O3": (43, 9, 0.1, 0.1, 0, 0.0, (0, 0, 0, 0), 0, 0.285, 0.27),
    "O4": (22, 4, 0.1, 0.2, 1, 0.1, (0, 0, 0, 0), 1, 0.335, 0.32),
    "O5": (74, 10, 0.0, 0.8, 5, 0.7, (3, 0, 0, 0), 0, 0.24, 0.225),
    "O6": (0, 0, 0.0, 0.0, 1, 0.1, (0, 0, 0, 0), 1, 0.335, 0.32),
    "O7": (94, 12, 0.1, 0.1, 1, 0.1, (3, 0, 0, 3), 4, 0.54, 0.525),
    "O8": (580, 100, 0.0, 0.0, 0, 0.0, (0, 0, 0, 0), 0, 0.255, 0.24),
}
