"""Prompt texts. ``<<name>>`` marks a value."""

from __future__ import annotations

QUESTION_PROMPT = """Project context:
- Framework: <<framework>>
- Language: <<language>>
- This file handles: <<category>>
- File path (USE THIS EXACTLY in codeReference.file): <<path>>
- Code starts at line <<start>> in that file

Code to quiz on (lines <<start>>–<<end>>):
```<<language>>
<<code>>
```


Generate exactly <<count>> multiple-choice questions about this code.
Difficulty level: <<difficulty>>/5

IMPORTANT for codeReference:
- "file" MUST be exactly: "<<path>>" — do NOT invent or change this path
- "startLine" and "endLine" must be real line numbers from the code above (starting at line <<start>>)
- The correct option MUST be derivable from reading the actual code above — not from general knowledge

Return JSON in this exact format:
{
  "questions": [
    {
      "id": "q1",
      "question": "The actual question text",
      "difficulty": 3,
      "category": "error-handling",
      "codeReference": {
        "file": "<<path>>",
        "startLine": <<start>>,
        "endLine": <<start_5>>
      },
      "options": [
        {"label": "A", "text": "Option A text", "isCorrect": false},
        {"label": "B", "text": "Option B text", "isCorrect": true},
        {"label": "C", "text": "Option C text", "isCorrect": false},
        {"label": "D", "text": "Option D text", "isCorrect": false}
      ],
      "explanation": "Detailed explanation referencing specific lines of the provided code",
      "dangerNote": "Real-world consequence if developer gets this wrong"
    }
  ]
}"""

ANSWER_PROMPT = """A developer was quizzed on their own code.

Question: "<<question>>"
<<code>>
Their answer: "<<user_answer>>"
Correct answer: "<<correct_answer>>"
Result: <<result>>

Write specific, helpful feedback (2-3 sentences) explaining <<focus>>.
Reference the actual code where relevant.

Return JSON:
{
  "understandingDepth": "<<depths>>",
  "feedback": "Specific feedback referencing the code",
  "conceptGap": <<gap>>
}"""

LEARNING_PROMPT = """Given these danger zones in the codebase:
<<zones>>

Generate a prioritized learning path. For each item, specify:
- Which file to read
- Which specific lines to focus on
- What concept to understand
- Why it matters (real-world consequence of not understanding it)

Return JSON array ordered by priority:
{
  "items": [
    {
      "file": "path/to/file.ts",
      "startLine": 1,
      "endLine": 50,
      "concept": "What to understand",
      "whyItMatters": "Real-world consequence",
      "priority": 1
    }
  ]
}"""
