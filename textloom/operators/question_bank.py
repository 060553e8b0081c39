"""Fixed question forms of the passage generators, by subject; {kt} is the key term, {a} and {b} the noun phrases."""

from __future__ import annotations

# Cues, as patterns over a passage.
CUES = {
    "definition": "(?i)\\b(?:is defined as|refers to|is a |are a |means|can be described as|known as)\\b",
    "cause": "(?i)\\b(?:because|due to|causes?|led to|results? in|reason for|therefore)\\b",
    "compare": "(?i)\\b(?:differ|whereas|while|unlike|compared|contrast|however|distinguish|difference)\\b",
    "process": "(?i)\\b(?:process|mechanism|forms?|develops?|produc(?:es|ed)|works?|steps?)\\b",
    "example": "(?i)\\b(?:for example|such as|like|instance|including|e\\.g\\.)\\b",
    "importance": "(?i)\\b(?:important|significant|crucial|essential|major|key role|plays a)\\b",
    "list": "(?i)\\b(types|kinds|forms|features|characteristics|factors|elements|components|stages|effects)\\b",
    "number": "\\b([0-9]{3,}[,0-9]*)\\b",
}
# Cues that biology reads otherwise or has alone.
BIOLOGY_CUES = CUES | {
    "process": "(?i)\\b(?:process|mechanism|forms?|develops?|produc(?:es|ed)|works?|steps?|cycle)\\b",
    "importance": "(?i)\\b(?:important|significant|crucial|essential|major|key role|plays a|function|advantage|use)\\b",
    "list": "(?i)\\b(types|kinds|forms|features|characteristics|factors|elements|components|stages|effects|parts|organs|tissues|cells)\\b",
    "number": "(?i)([0-9]+\\.?[0-9]*\\s*[xX×/÷]\\s*[0-9]|magnification\\s*=|estimated size\\s*=|actual size\\s*=|field.{0,20}diameter|energy available at.{0,30}trophic|10%\\s*(of|rule|energy)|F1.{0,50}F2|cross between.{0,30}(TT|Tt|tt|RR|Rr|rr)|[0-9]+\\s*:\\s*[0-9]+.{0,20}(?:ratio|phenotype|genotype)|calculate.{0,60}(energy|size|ratio|number)|step\\s*[0-9]+\\s*(?:\\(|:).{0,60}(?:given|formula|calculation)|given\\s*:\\s*.{0,30}=\\s*[0-9])",
    "formula": "(?i)(formula.{0,30}=|estimated size.{0,20}=|magnification.{0,20}=|diameter.{0,30}(µm|micrometre|micrometer)|[0-9]+\\s*(µm|nm|mm)\\s*/\\s*[0-9]+)",
    "function": "(?i)\\b(?:function|role|helps|responsible for|allows)\\b",
}
# Fixed values: (condition, intent, question), in order. "two" and "one" ask for so many noun phrases, "start" for a fit first sentence.
BIOLOGY = [
    ("", "explain_concept", "Explain {kt} in the context of {chapter}."),
    ("start", "explain_concept", "Describe in detail: {first}?"),
    ("", "definition", "What is meant by {kt}?"),
    ("definition", "definition", "Define {kt} as given in your NCERT textbook."),
    ("definition", "short_answer", "What is {kt}? Give a brief definition in 2–3 sentences."),
    ("cause", "explain_concept", "What are the causes or factors responsible for {kt}?"),
    ("cause", "short_answer", "Why does {kt} occur? Give reasons."),
    ("compare two", "compare_concepts", "What is the difference between {a} and {b}?"),
    ("compare two", "compare_concepts", "Compare {a} and {b}."),
    ("compare few", "compare_concepts", "How does {kt} differ from related biological concepts?"),
    ("process", "explain_concept", "Explain the biological process of {kt}."),
    ("process", "explain_concept", "How does {kt} work or develop? Describe step by step."),
    ("example", "give_example", "Give an example of {kt} as mentioned in the chapter."),
    ("example", "give_example", "Illustrate {kt} with an example from the NCERT text."),
    ("importance", "application_reallife", "Why is {kt} important? Discuss its significance."),
    ("importance", "application_reallife", "What is the role or function of {kt} in living organisms?"),
    ("list", "list_enumerate", "List the {list} of {kt}."),
    ("list", "list_enumerate", "What are the main {list} of {kt}?"),
    ("function", "describe_function", "What is the main function of {kt}?"),
    ("function", "describe_function", "Describe the role of {kt} in {chapter}."),
    ("number", "numerical_problem", "Based on the NCERT text, solve or explain the numerical problem related to {kt}. Show step-by-step calculation."),
    ("number", "numerical_problem", "A numerical problem involves {kt}. Using the information in the chapter, show how to calculate the result step by step."),
    ("formula", "formula_application", "Using the formula described in the text for {kt}, explain how to compute the result. Give an example with numbers."),
    ("one", "explain_concept", "What is the significance of {a} in {chapter}?"),
    ("two", "explain_concept", "How are {a} and {b} related in biology?"),
    ("", "application_reallife", "How is {kt} relevant to human life or nature?"),
    ("", "analytical", "What would happen if {kt} did not function properly in a living organism?"),
]
# As above, for the social sciences.
SOCIAL_SCIENCE = [
    ("", "explain_concept", "Explain {kt} in the context of {chapter}."),
    ("start", "explain_concept", "Describe in detail: {first}?"),
    ("", "definition", "What is meant by {kt}?"),
    ("definition", "definition", "Define {kt} as mentioned in your NCERT textbook."),
    ("definition", "short_answer", "What is {kt}? Write a brief definition in your own words."),
    ("cause", "explain_concept", "What are the causes or factors responsible for {kt}?"),
    ("cause", "short_answer", "Why does {kt} occur or exist? Explain with reasons."),
    ("compare two", "compare_concepts", "What is the difference between {a} and {b}?"),
    ("compare two", "compare_concepts", "Compare {a} and {b} in the context of {subject}."),
    ("compare few", "compare_concepts", "How does {kt} differ from related concepts in {subject}?"),
    ("process", "explain_concept", "Explain the process of {kt} as described in the chapter."),
    ("process", "explain_concept", "How does {kt} work? Describe step by step."),
    ("example", "give_example", "Give an example of {kt} as mentioned in the chapter."),
    ("example", "give_example", "Illustrate {kt} with a real-life example from Indian context."),
    ("importance", "application_reallife", "Why is {kt} important? Discuss its significance."),
    ("importance", "application_reallife", "What is the role of {kt} in {low}?"),
    ("list", "list_enumerate", "List the {list} of {kt}."),
    ("list", "list_enumerate", "What are the main {list} of {kt}?"),
    ("number", "short_answer", "What does the figure {number} represent in the context of {kt}?"),
    ("one", "explain_concept", "What is the significance of {a} in {chapter}?"),
    ("two", "explain_concept", "How are {a} and {b} related?"),
    ("", "application_reallife", "How is {kt} relevant to Indian society or daily life?"),
    ("", "analytical", "What would be the consequences if {kt} did not exist in {low}?"),
]
#: Entries of a sentence: (intent, question forms, answer); {s} is the sentence, {short} its first 100 characters. The forms are this package's own; one is picked by a hash.
ENTRIES = [
    ("true_false", ["Is this true or false? {s}"], "True. {s}"),
    ("short_answer", ["Say in a few words what this states: {short}"], "{s} It is a point of {chapter}."),
    ("explain_concept", ["Explain what this says: {short}"], "{s} It helps to understand {chapter}."),
    ("definition", ["What does {term} mean?"], "{s}"),
    ("fill_blank", ["Complete the sentence: {gapped}"], "The missing word is {word}. {s}"),
    ("application_reallife", ["Where does this matter in daily life? {short}", "Which case from daily life shows this? {short}", "Why does this matter today? {short}"], "{s} It matters in daily life."),
    ("analytical", ["Examine this statement: {short}", "What follows from this? {short}", "How much weight does this have? {short}"], "{s} It shows a side of {chapter}."),
    ("give_example", ["Give a case of this: {short}", "Which case supports this? {short}"], "{s} It stands for what {chapter} is about."),
    ("list_enumerate", ["List what this names: {short}", "Which items does this name? {short}"], "{s} These are named in {chapter}."),
    ("compare_concepts", ["Compare what this sets side by side: {short}", "Which contrast does this draw? {short}"], "{s} It sets ideas of {chapter} side by side."),
    ("one_word", ["In a word or phrase: what is {key}?"], "{brief}. ({s})"),
]
# When a sentence gives an entry of a kind.
DEFINING = [" is ", " are ", " refers to ", " means ", " defined as ", " known as "]
NAMING = [" is ", " are ", " was "]
LISTING = [", ", "; ", " such as ", " including ", " namely ", " like ", " are: "]
CONTRAST = ["while", "whereas", "unlike", "however", "but", "on the other hand", "in contrast", "although", "difference", "compared to", "both", "either"]
GAP_STOPS = "the a an is are was were in on at by of to and or for with from that this their its it he she they which been be have has had will would".split()
