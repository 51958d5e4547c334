"""Judge prompt templates (fixed values).

Placeholders use ``str.format`` syntax; doubled braces are literal braces.
"""

# --- fixed values: the two judge prompts, verbatim ---
SCALAR_PROMPT = """
    You are evaluating a Darija summarization model.
    
    Original text: {input}
    Reference summary: {reference}  
    Model summary: {prediction}
    
    Score the model summary on:
    1. Faithfulness (1-5): Does it accurately reflect the original?
    2. Darija quality (1-5): Is it natural Darija, not MSA?
    3. Conciseness (1-5): Is it appropriately short?
    
    Respond in JSON only.
    """

PAIRWISE_PROMPT = """
    أنت خبير في تقييم جودة تلخيص النصوص بالدارجة المغربية.
    مهمتك هي المقارنة بين ملخصين وتحديد أيهما أفضل.

    النص الأصلي:
    {input}

    الملخص المرجعي (الإجابة الصحيحة):
    {reference}

    الملخص A:
    {prediction_a}

    الملخص B:
    {prediction_b}

    قارن بين الملخصين على ثلاثة محاور:

    1. الدقة (Faithfulness): أيهما يعكس النص الأصلي بشكل أدق بدون هلوسة؟
    2. جودة الدارجة (Darija Quality): أيهما يستخدم دارجة مغربية أكثر طبيعية؟
    3. الإيجاز (Conciseness): أيهما أكثر إيجازاً وتركيزاً؟

    قواعد مهمة:
    - يجب أن تختار winner واضح في كل محور، لا يوجد تعادل
    - إذا كان الفرق طفيفاً، اختر الأفضل ولو بفارق بسيط
    - كن صارماً وموضوعياً

    أجب فقط بـ JSON بهذا الشكل بدون أي نص إضافي:
    {{
    "faithfulness": {{
        "winner": "A" or "B",
        "confidence": "low" or "medium" or "high",
        "reason": "<one sentence>"
    }},
    "darija_quality": {{
        "winner": "A" or "B",
        "confidence": "low" or "medium" or "high",
        "reason": "<one sentence>"
    }},
    "conciseness": {{
        "winner": "A" or "B",
        "confidence": "low" or "medium" or "high",
        "reason": "<one sentence>"
    }},
    "overall_winner": "A" or "B",
    "overall_confidence": "low" or "medium" or "high",
    "overall_reason": "<one sentence>"
    }}
    """
# --- end of fixed values ---
