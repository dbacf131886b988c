"""Chat templates: how a conversation of one model family is written as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Template:
    """Markers of one template.

    ``system_header`` and ``tool_header`` serve the native rendering; where they
    are None the template has no native form here and is rendered from its
    headers alone.
    """

    assistant_header: str | None
    user_header: str | None
    system_prompt: str | None
    end_of_turn: str | None
    parser_type: str = "general"
    pattern_type: str = "general"
    enable_thinking: bool = False
    system_header: str | None = None
    tool_header: str | None = None
    bos: str = ""
    #: Where the native text differs from the headers that mark spans.
    native_user: str | None = None
    history_assistant: str | None = None
    last_assistant: str | None = None
    system_suffix: str = ""
    #: Replies of tools share a user turn, each between these two marks.
    tool_reply: tuple[str, str] | None = None
    #: Calls of tools follow the content, each between these two marks.
    tool_call: tuple[str, str] | None = None
    #: Earlier answers are written without the thoughts before this mark.
    thought_end: str | None = None
    #: What follows the assistant header where a row's thinking is off.
    thought_off: str | None = None


# The markers below must be exactly what the models were trained on.
DEFAULT_PROMPT = "You are a helpful assistant."
LONG_PROMPT = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, "
    "while being safe.  Your answers should not include any harmful, unethical, racist, sexist, "
    "toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased "
    "and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, "
    "explain why instead of answering something not correct. If you don't know the answer to a "
    "question, please don't share false information."
)
CHATML_SYSTEM = "<|im_start|>system\n"
CHATML_TOOL = "<|im_start|>tool\n"
CHATML_ASSISTANT = "<|im_start|>assistant\n"
CHATML_REPLY = ("\n<tool_response>\n", "\n</tool_response>")
CHATML_TOOLS = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>",
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>',
)
CHATML_CALL = ("\n<tool_call>\n", "\n</tool_call>")
THOUGHT_END = "</think>"
KIMI_USER = "<|im_user|>user<|im_middle|>"
DEEPSEEK_BOS = "<｜begin▁of▁sentence｜>"
TEMPLATES: dict[str, Template] = {
    "llama3": Template(
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
        "<|start_header_id|>user<|end_header_id|>",
        LONG_PROMPT,
        "<|eot_id|>",
        system_header="<|start_header_id|>system<|end_header_id|>\n\n",
        tool_header="<|start_header_id|>ipython<|end_header_id|>\n\n",
        bos="<|begin_of_text|>",
    ),
    "llama4": Template(
        "<|header_start|>assistant<|header_end|>\n\n",
        "<|header_start|>user<|header_end|>",
        DEFAULT_PROMPT,
        "<|eot|>",
        system_header="<|header_start|>system<|header_end|>\n\n",
        tool_header="<|header_start|>ipython<|header_end|>\n\n",
        bos="<|begin_of_text|>",
    ),
    "qwen": Template(
        "<|im_start|>assistant\n",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>\n",
        system_header=CHATML_SYSTEM,
        tool_header=CHATML_TOOL,
        tool_reply=CHATML_REPLY,
        tool_call=CHATML_CALL,
    ),
    "qwen2-vl": Template(
        "<|im_start|>assistant\n",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>\n",
        system_header=CHATML_SYSTEM,
        tool_header=CHATML_TOOL,
        tool_reply=CHATML_REPLY,
        tool_call=CHATML_CALL,
    ),
    "phi3": Template(
        "<|assistant|>\n",
        "<|user|>\n",
        DEFAULT_PROMPT,
        "<|end|>\n",
        system_header="<|system|>\n",
        tool_header="<|tool|>\n",
    ),
    "phi4": Template(
        "<|im_start|>assistant<|im_sep|>",
        "<|im_start|>user<|im_sep|>",
        DEFAULT_PROMPT,
        "<|im_end|>",
        system_header="<|im_start|>system<|im_sep|>",
        tool_header="<|im_start|>tool<|im_sep|>",
    ),
    "phi4-mini": Template(
        "<|assistant|>",
        "<|user|>",
        DEFAULT_PROMPT,
        "<|end|>",
        system_header="<|system|>",
        tool_header="<|tool|>",
    ),
    "gpt-oss-naive": Template(
        "<|start|>assistant<|channel|>analysis<|message|>",
        "<|start|>user<|message|>",
        None,
        "<|end|>",
        system_header="<|start|>system<|message|>",
        tool_header="<|start|>tool<|message|>",
    ),
    "gpt-oss": Template(None, None, None, None, parser_type="openai-harmony"),
    "deepseek-r1-distill": Template("<｜Assistant｜>", "<｜User｜>", None, None),
    "qwen3-thinking": Template(
        "<|im_start|>assistant\n",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>\n",
        parser_type="thinking",
        enable_thinking=True,
        system_header=CHATML_SYSTEM,
        tool_header=CHATML_TOOL,
        tool_reply=CHATML_REPLY,
        tool_call=CHATML_CALL,
        thought_end=THOUGHT_END,
        thought_off="<think>\n\n</think>\n\n",
    ),
    "qwen3-instruct": Template(
        "<|im_start|>assistant\n<think>\n\n</think>\n",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>\n",
        system_header=CHATML_SYSTEM,
        tool_header=CHATML_TOOL,
        tool_reply=CHATML_REPLY,
        tool_call=CHATML_CALL,
        history_assistant=CHATML_ASSISTANT,
        last_assistant="<|im_start|>assistant\n<think>\n\n</think>\n\n",
        thought_end=THOUGHT_END,
    ),
    "qwen3-next-thinking": Template(
        "<|im_start|>assistant\n<think>\n",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>\n",
        parser_type="thinking",
        enable_thinking=True,
        system_header=CHATML_SYSTEM,
        tool_header=CHATML_TOOL,
        tool_reply=CHATML_REPLY,
        tool_call=CHATML_CALL,
        history_assistant=CHATML_ASSISTANT,
        thought_end=THOUGHT_END,
        thought_off="\n</think>\n\n",
    ),
    "kimi-k2-thinking": Template(
        "<|im_assistant|>assistant<|im_middle|>",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>",
        parser_type="thinking",
        enable_thinking=True,
        system_header="<|im_system|>system<|im_middle|>",
        tool_header="<|im_system|>tool<|im_middle|>",
        native_user=KIMI_USER,
        history_assistant="<|im_assistant|>assistant<|im_middle|><think></think>",
    ),
    "kimi-k2-instruct": Template(
        "<|im_assistant|>assistant<|im_middle|>",
        "<|im_start|>user\n",
        DEFAULT_PROMPT,
        "<|im_end|>",
        system_header="<|im_system|>system<|im_middle|>",
        tool_header="<|im_system|>tool<|im_middle|>",
        native_user=KIMI_USER,
    ),
    "deepseek-v3": Template(
        "<｜Assistant｜>", "<｜User｜>", DEFAULT_PROMPT, "<｜end▁of▁sentence｜>", bos=DEEPSEEK_BOS
    ),
    "ling-flash-2.0": Template(
        "<role>ASSISTANT</role>",
        "<role>HUMAN</role>",
        DEFAULT_PROMPT,
        "<|role_end|>",
        system_header="<role>SYSTEM</role>",
        tool_header="<role>OBSERVATION</role>",
        system_suffix="\ndetailed thinking off",
    ),
    "deepseek-v32": Template(
        "<｜Assistant｜>",
        "<｜User｜>",
        "",
        "<｜end▁of▁sentence｜>",
        parser_type="thinking",
        enable_thinking=True,
        bos=DEEPSEEK_BOS,
        thought_off="</think>",
    ),
    "gemma": Template(
        "<start_of_turn>model\n",
        "<start_of_turn>user\n",
        DEFAULT_PROMPT,
        "<end_of_turn>\n",
        system_header="<start_of_turn>system\n",
        tool_header="<start_of_turn>tool\n",
        bos="<bos>",
    ),
    "longcat": Template(
        " ASSISTANT:", " USER:", DEFAULT_PROMPT, "</longcat_s>", pattern_type="round"
    ),
    "longcat_xml": Template(
        "<longcat_assistant>", "<longcat_user>", DEFAULT_PROMPT, "</longcat_s>"
    ),
}


def register_template(name: str, template: Template, override: bool = False) -> None:
    """Add a template; an existing name needs ``override``."""
    if name in TEMPLATES and not override:
        raise ValueError(f"template {name!r} is already registered")
    TEMPLATES[name] = template


def get_template(name: str) -> Template:
    if name not in TEMPLATES:
        raise KeyError(f"no template {name!r}; known: {template_names()}")
    return TEMPLATES[name]


def template_names() -> list[str]:
    return list(TEMPLATES)


def template_table(spark: SparkSession) -> DataFrame:
    """The registry as a table, one row per template."""
    rows = [
        (
            name,
            t.assistant_header,
            t.user_header,
            t.system_prompt,
            t.end_of_turn,
            t.parser_type,
            t.pattern_type,
            t.enable_thinking,
        )
        for name, t in TEMPLATES.items()
    ]
    return spark.createDataFrame(
        rows,
        "name string, assistant_header string, user_header string, system_prompt string, "
        "end_of_turn string, parser_type string, pattern_type string, enable_thinking boolean",
    )
