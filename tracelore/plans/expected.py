"""Inputs with the results that they must have: sentences and their classes, segments, answers, stated confidences. Fixed values."""

from __future__ import annotations

SEVEN = {
    "B": ["Wait, that's wrong. Let me reconsider.", "No, I made an error in the calculation.", "Actually, the formula should be different.", "That doesn't seem right."],
    "R": ["Let me try a different approach.", "Alternatively, we could use integration.", "Starting over with a new method.", "Instead, let me consider the problem from scratch."],
    "V": ["Let me check this result.", "Let me verify by substituting back in.", "Double-checking the arithmetic.", "Is this correct?"],
    "C": ["Therefore, the answer is 42.", "So the final answer is \\boxed{42}.", "In conclusion, x = 7."],
    "S": ["First, I need to find the derivative.", "Step 1: Set up the equation.", "To solve this, we need to factor the polynomial.", "Let me start by defining the variables."],
    "H": ["Hmm, this is tricky.", "I'm not sure about this step.", "I wonder if there's a simpler way."],
    "F": ["We can write f(x) = 3x^2 + 2x - 1.", "The eigenvalues of A are 1, 2, and 3.", "Applying the quadratic formula gives us."],
}
SIX = {
    "X": ["Wait, that's wrong. Let me reconsider.", "No, I made an error in step 2.", "Actually, the formula should be different.", "That doesn't work out correctly.", "I was wrong about the sign.", "My previous calculation was incorrect."],
    "R": ["Let me try a completely different approach.", "Starting over from scratch.", "Alternatively, I could use integration.", "Instead, let me consider the dual problem.", "Switching to a geometric approach."],
    "V": ["Let me check this result.", "Double-checking the arithmetic now.", "Is this answer correct?", "To verify, let me plug x = 3 back in.", "Does this make sense?"],
    "C": ["Therefore, the answer is 42.", "In conclusion, x equals 7.", "Thus, the solution is x = 5.", "Hence the answer is 12."],
    "H": ["Hmm, this is quite tricky.", "I wonder if there's a simpler way.", "I'm confused about the sign convention here.", "Uh, let me think about this for a moment."],
    "F": ["We can write f(x) = 3x^2 + 2x - 1.", "The eigenvalues of A are 1, 2, and 3."],
}
#: (text, fewest sentences, most sentences)
SEGMENTS = [
    ("First, let me compute the derivative. Then I will evaluate it at x=0.", 2, 2), ("The value is 3.14 and we need to compare it with 2.72.", 1, 1), ("We have $f(x) = x^2 + 3.5x - 1$. Setting this equal to zero gives us the roots.", 2, 2),
    ("First paragraph here.\n\nSecond paragraph here.", 2, 2), ("Line one of reasoning.\nLine two of reasoning.", 2, 2), ("Wait. That's not right. Let me reconsider.", 2, 3), ("From Eq. 5 we can see that the result follows. This proves the claim.", 2, 2),
    ("", 0, 0), ("So we have 1, 2, 3, ... and this continues. The pattern is clear.", 2, 2), ("Let f(x) = x^2 + 2x + 1. We can factor this as (x+1)^2. Setting f(x) = 0, we get x = -1.", 2, 3),
]
BOXED = [(r"\boxed{42}", "42"), (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{(3, \frac{\pi}{2})}", r"(3, \frac{\pi}{2})"), (r"\boxed{\sqrt{x^{2}+1}}", r"\sqrt{x^{2}+1}"), (r"\boxed{A} then \boxed{B}", "B"), ("no boxed here", None)]
NORMALIZED = [
    (r"\boxed{42}", "42"), (r"\boxed{(3, \frac{\pi}{2})}", r"(3, \frac{\pi}{2})"), ("$x+1$", "x+1"), (r"\text{cm}", "cm"), ("  3  +  4  ", "3 + 4"), ("42.", "42"), ("3.14", "3.14"), (r"\left( 3, \frac{\pi}{2} \right)", r"(3, \frac{\pi}{2})"), ("( 3, x )", "(3, x)"), ("[ 1, 2 ]", "[1, 2]"),
]
EQUIVALENT = [
    ("42", "42", True), (r"\boxed{42}", "42", True), ("0.5", "1/2", True), (r"\frac{1}{2}", "0.5", True), ("-3", "-3", True), ("42", "43", False), ("0.333", "1/3", False), ("50%", "0.5", True), ("1,234", "1234", True),
    (r"(3, \frac{\pi}{2})", r"\left( 3, \frac{\pi}{2} \right)", True), (r"\boxed{(3, \frac{\pi}{2})}", r"\left( 3, \frac{\pi}{2} \right)", True),
]
NUMERIC = [("1/2", 0.5), (r"\frac{3}{4}", 0.75), ("50%", 0.5), ("1,234", 1234.0), ("-3", -3.0), ("x", None), ("1/0", None)]
STATED = [
    (r"\boxed{42}", "42"), (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"The answer is \boxed{\sqrt{2}}.", r"\sqrt{2}"), ("The answer is 7.", "7"), ("Therefore, the answer is 100", "100"), ("The polar coordinates are (3, pi/2).\n\n\\boxed{(3, \\frac{\\pi}{2})}", r"(3, \frac{\pi}{2})"), ("nothing", None),
]
MARKED = [("Some steps...\n#### 42", "42"), ("Some steps...\n#### 1,234", "1234"), ("#### 3.14", "3.14"), ("so 5 and 6", "6")]
CHOSEN = [("The answer is A", "A"), (r"\boxed{B}", "B"), ("I choose (C)", "C"), ("After analysis:\nD", "D"), ("hm", None)]
#: (answer, truth, kind, extraction, verdict)
SCORED = [
    ("The answer is 42", "42", "exact_match_math", None, True), ("The answer is 43", "42", "exact_match_math", None, False), ("I think C is correct", "C", "multiple_choice", None, True), ("Some steps...\nThe final answer is 7", "Some explanation\n#### 7", "exact_match_numeric", "gsm8k", True),
    (r"The polar coordinates are \((3, \frac{\pi}{2})\). \boxed{(3, \frac{\pi}{2})}", r"\left( 3, \frac{\pi}{2} \right)", "exact_match_math", None, True), (r"\boxed{\frac{7}{3}}", r"\frac{7}{3}", "exact_match_math", None, True), ("I choose (B)", "2", "multiple_choice", None, True), ("x", "1", "other", None, None),
]
CONFIDENCES = [("Confidence: 85", 0.85), ("I'm 75% confident", 0.75), ("I am not sure", 0.3), ("absolutely sure", 0.9), ("probably", 0.6), ("plain", 0.5), ("confidence level: 8/10", 0.08)]
JUDGED = [("Probability: 0.7", 0.7), ("Judgment: INCORRECT", 0.1), ("x", None)]
BYTES = [("helloĠworldĊ", "hello world\n"), ("plain", "plain")]
