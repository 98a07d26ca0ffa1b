"""Default prompt templates, as data.

Every template is a plain string with named places; the operators take other
tables of the same shape, so a user can supply their own wording.
"""

TRAINING_TEMPLATES = {
    "qa_pairs": (
        "Write {num_items} question and answer pairs about the passage below.\n"
        "Each answer must be supported by the passage.\n"
        "Reply with a JSON array of objects with keys question, answer, difficulty.\n\nPASSAGE:\n{content}"),
    "classification": (
        "Write {num_items} labelled examples from the passage below.\nTask: {classification_task}\nLabels: {labels}\n"
        "Reply with a JSON array of objects with keys text, label, confidence.\n\nPASSAGE:\n{content}"),
    "instruction_following": (
        "Write {num_items} instructions with their outputs, using the passage below as material.\n"
        "Reply with a JSON array of objects with keys instruction, input, output.\n\nPASSAGE:\n{content}"),
    "few_shot_examples": (
        "Write {num_items} worked examples for this task: {task_description}\n"
        "Reply with a JSON array of objects with keys input, output, explanation.\n\nPASSAGE:\n{content}"),
    "dialogue_data": (
        "Write {num_items} exchanges between a user and an assistant about the passage below.\n"
        "Reply with a JSON array of objects with keys user_message, assistant_response, context.\n\nPASSAGE:\n{content}"),
    "summarization_data": (
        "Write {num_items} {summary_type} summaries of parts of the passage below.\n"
        "Reply with a JSON array of objects with keys source_text, summary.\n\nPASSAGE:\n{content}"),
}
TRAINING_PARAMETERS = {
    "num_items": "3", "classification_task": "Topic Classification", "labels": "positive, negative, neutral",
    "task_description": "Extract key insights from text", "summary_type": "Abstractive",
}

DIALOGUE_STYLES = {
    "Q&A": "Create clear, educational question-answer pairs",
    "Conversation": "Create natural conversation exchanges between two people",
    "Interview": "Create interview-style questions and detailed answers",
}
DIALOGUE_TEMPLATE = (
    "{style} from the text below.\nWrite exactly {num_items} items grounded in the text.{topics}\n"
    "Reply with a JSON array of objects with keys question, answer.\n\nTEXT:\n{content}")

# persona key: (name, manner)
NARRATORS = {
    "ramana_maharshi": ("Ramana Maharshi", "quiet inquiry into the self"),
    "einstein": ("Albert Einstein", "wonder, thought experiments and plain words"),
    "elon_musk": ("Elon Musk", "first principles and bold plans"),
    "shakespeare": ("William Shakespeare", "verse, metaphor and drama"),
    "gandhi": ("Mahatma Gandhi", "gentle moral reasoning"),
    "steve_jobs": ("Steve Jobs", "simplicity and stagecraft"),
    "rumi": ("Rumi", "poetry of love and longing"),
    "carl_sagan": ("Carl Sagan", "cosmic perspective and awe"),
}
REWRITERS = {
    "3_year_old": "3-Year-Old Child", "5_year_old": "5-Year-Old Child", "teenager": "Teenager",
    "pirate": "Pirate Captain", "zen_monk": "Zen Monk", "dog": "Friendly Dog", "cat": "Sophisticated Cat",
    "scientist": "Curious Scientist", "poet": "Romantic Poet", "comedian": "Stand-up Comedian",
    "shakespeare": "William Shakespeare", "einstein": "Albert Einstein", "yoda": "Master Yoda",
}
NARRATOR_TEMPLATE = (
    "Tell the content below as {name} would, with {manner}.\nNarrative style: {style}\nKeep the facts.\n\nCONTENT:\n{content}")
REWRITE_TEMPLATE = "Rewrite the text below in the voice of {name}.\nTone: {tone}\nLength: {length}\n\nTEXT:\n{content}"

KNOWLEDGE_TYPES = {  # key: (name, request, reply keys)
    "analogies": ("Analogies & Metaphors", "analogies that explain its ideas", "concept, analogy, explanation"),
    "socratic_questions": ("Socratic Questioning", "questions that lead a reader to insight", "main_question, thinking_direction"),
    "riddles_puzzles": ("Riddles & Puzzles", "riddles or puzzles with solutions", "puzzle_type, riddle_or_puzzle, explanation"),
    "concept_connections": ("Concept Connections", "unexpected links between concepts", "concept_a, concept_b, connection_explanation, surprising_insight"),
    "creative_explanations": ("Creative Explanations", "inventive explanations", "concept, explanation, main_lesson"),
    "paradox_exploration": ("Paradox Exploration", "paradoxes and what they show", "paradox_statement, deeper_truth"),
}
KNOWLEDGE_TEMPLATE = (
    "From the content below write {num_items} {request}.\nLevel: {difficulty}\n"
    "Reply with a JSON array of objects with keys {keys}.\n\nCONTENT:\n{content}")

REFINEMENT_REQUESTS = {
    "improve_clarity": "Make it clearer without changing its meaning.",
    "enhance_engagement": "Make it more engaging for the reader.",
    "fix_grammar_style": "Correct grammar, spelling and style.",
    "adjust_tone": "Change its tone to {target_tone}.",
    "simplify_language": "Use simpler words and shorter sentences.",
    "add_examples": "Add concrete examples.",
    "increase_detail": "Add depth and detail.",
    "custom_refinement": "{custom_instructions}",
}
REFINEMENT_TEMPLATE = "Revise the content below. {request}\nReturn only the revised content.\n\nCONTENT:\n{content}"

# --- fixed values: rule-based record texts -------------------------------------
RULE_QUESTIONS = [
    "What is the main topic of this text?", "What are the key points mentioned?", "How would you summarize this content?",
]
NARRATOR_FALLBACKS = {
    "einstein": "As I contemplate this fascinating subject, I am struck by the wonder of it all. {content} How marvelous that we can explore such mysteries with our curious minds!",
    "ramana_maharshi": "Let us inquire into this together. {content} Who is it that seeks to understand? What is the nature of the one who knows?",
    "shakespeare": "Hark! What wisdom doth unfold before us. {content} Verily, such knowledge doth illuminate the very essence of our being.",
}
NARRATOR_FALLBACK = "[In the voice of {name}]: {content}"
REWRITE_FALLBACKS = {
    "3_year_old": "Wow! {content} That's so cool!",
    "pirate": "Arrr, matey! {content} What an adventure!",
    "zen_monk": "In mindful contemplation, we observe: {content} Such is the way of understanding.",
}
REWRITE_FALLBACK = "[{name} voice]: {content}"
KNOWLEDGE_FALLBACKS = {  # type: (id part, title, content, educational, entertainment)
    "analogies": ("analogy", "Simple Analogy", "This concept is like a puzzle - each piece of understanding fits together to create the complete picture.", 0.6, 0.5),
    "socratic_questions": ("socratic", "Reflective Question", "What would happen if you applied this knowledge in your daily life?", 0.7, 0.6),
    "riddles_puzzles": ("riddle", "Knowledge Riddle", "I am learned but not taught, understood but not explained. What am I?", 0.6, 0.7),
}
KNOWLEDGE_FALLBACK = ("Knowledge Insight", "This content contains valuable insights that can be explored through {type}.", 0.5, 0.5)
REFINEMENT_FALLBACKS = {
    "improve_clarity": "[CLARITY IMPROVED] {content}", "enhance_engagement": "[ENGAGEMENT ENHANCED] {content}",
    "fix_grammar_style": "[GRAMMAR FIXED] {content}", "simplify_language": "[SIMPLIFIED] {content}",
    "add_examples": "{content}\n\n[EXAMPLE ADDED] For instance, this concept can be applied in real-world scenarios.",
    "increase_detail": "{content}\n\n[DETAIL ADDED] This topic involves several important considerations and applications.",
}
REFINEMENT_FALLBACK = "[REFINED] {content}"

# --- fixed values: enhanced prompt parts ------------------------------------------
BASE_REQUESTS = {
    "rewrite_story": "Rewrite the following content for {persona} in a {tone} tone, keeping its meaning.",
    "training_data": "Turn the following content into training examples of format {format}.",
    "quirky_knowledge": "Turn the following content into {knowledge_type} that teach and entertain.",
    "persona_narrator": "Narrate the following content as {persona} would.",
}
