"""Values that results depend on."""

# Fixed values -----------------------------------------------------------------------------------
BOLD_START = ""
BOLD_END = ""
INDEX_STOP = (
    "the a an and or of to in for on with as by is are be this that it its from at "
    "if then else when which who will can may not no"
).split()
KEYWORD_STOP = (
    "a an the and or of to in for on with as by is are be this that these those "
    "it its from at if then else when which who whom whose will shall can may "
    "not no all any each per such into out over under up down off above below "
    "bit bits register value values data set reset read write address mode "
    "figure table section chapter page note see also etc using used use one two "
    "three four five high low pin pins"
).split()
C_HINTS = ("#include", "void ", "int ", "uint", "return", "for (", "while (", "if (", "{", "}", ";", "PORT", "DDR", "0x")
ASM_HINTS = (" ldi ", " out ", " in ", " rjmp ", " sbi ", " cbi ", " mov ", ".org", ".equ")
BULLETS = "•·–—*▪◦‣"
BODY_SIZE = 11.0
CODE_TITLE = "Example from datasheet"
PALETTE_PAGES = (
    ("Register map", "registers.html"),
    ("Code examples", "code.html"),
    ("Reference builder", "reference.html"),
    ("Personal Reference", "starred.html"),
    ("Search", "search.html"),
    ("How it's generated", "how.html"),
)
GLOSSARY = {
    "ADC": "Analog-to-Digital Converter",
    "DAC": "Digital-to-Analog Converter",
    "PWM": "Pulse-Width Modulation",
    "GPIO": "General-Purpose Input/Output",
    "UART": "Universal Asynchronous Receiver/Transmitter",
    "USART": "Universal Synchronous/Asynchronous Receiver/Transmitter",
    "SPI": "Serial Peripheral Interface",
    "I2C": "Inter-Integrated Circuit (two-wire serial bus)",
    "TWI": "Two-Wire Interface (I²C-compatible)",
    "DMA": "Direct Memory Access",
    "NVIC": "Nested Vectored Interrupt Controller",
    "ISR": "Interrupt Service Routine",
    "IRQ": "Interrupt Request",
    "WDT": "Watchdog Timer",
    "RTC": "Real-Time Clock",
    "PLL": "Phase-Locked Loop",
    "CRC": "Cyclic Redundancy Check",
    "FIFO": "First-In, First-Out buffer",
    "MISO": "Master In, Slave Out (SPI)",
    "MOSI": "Master Out, Slave In (SPI)",
    "SCK": "Serial Clock (SPI)",
    "SCL": "Serial Clock line (I²C)",
    "SDA": "Serial Data line (I²C)",
    "MCU": "Microcontroller Unit",
    "CPU": "Central Processing Unit",
    "ALU": "Arithmetic Logic Unit",
    "RAM": "Random-Access Memory",
    "ROM": "Read-Only Memory",
    "SRAM": "Static Random-Access Memory",
    "EEPROM": "Electrically Erasable Programmable Read-Only Memory",
    "FLASH": "Flash (non-volatile) program memory",
    "JTAG": "Joint Test Action Group debug interface",
    "SWD": "Serial Wire Debug",
    "LSB": "Least-Significant Bit",
    "MSB": "Most-Significant Bit",
    "OSC": "Oscillator",
    "VREF": "Reference Voltage",
    "BOD": "Brown-Out Detection",
    "POR": "Power-On Reset",
    "CMOS": "Complementary Metal-Oxide-Semiconductor",
    "TTL": "Transistor-Transistor Logic",
    "MOSFET": "Metal-Oxide-Semiconductor Field-Effect Transistor",
    "LED": "Light-Emitting Diode",
    "CTC": "Clear Timer on Compare match",
    "PRR": "Power Reduction Register",
    "SFR": "Special Function Register",
    "LDO": "Low-Dropout (voltage regulator)",
    "ESD": "Electrostatic Discharge",
    "RISC": "Reduced Instruction Set Computer",
    "AC": "Analog Comparator",
    "POT": "Power-On Threshold",
}
INDEX_TOKEN = r"[a-z0-9_]+"
KEYWORD_TOKEN = r"[A-Za-z][A-Za-z0-9_]{2,}"
GLOSSARY_TOKEN = r"[A-Za-z][A-Za-z0-9/²]*"
REGISTER_HEADING = (
    r"(?mdU)^\s*(?:\d+(?:\.\d+)*\s+)?([A-Z][A-Z0-9_]{1,15})\s*[–—:-]\s*"
    r"([A-Z][^\n]{0,80}?Register[A-Za-z0-9 ]*)\s*$"
)
BIT_ROW = r"(?mdU)^\s*Bits?\s+(\d+(?:\s*[:\-]\s*\d+)?)\s*[–—:-]\s*([A-Za-z0-9_/]+)\s*[:–—-]?\s*([^\n]{0,80})"
# A look ahead at two letters, in any case (that of a long s too), spares a test for a word at every place.
SECTION_REF = r"(?iU)(?-iU:(?=[SsſCc][EeHh]))\b(?:(?:see\s+)?(?:Section|Sections|Chapter|Chapters)\s+)(\d+(?:\.\d+)*)"
PAGE_REF = r"(?iU)(?-iU:(?=[Pp][Aa]))\bpages?\s+(\d+)"
BULLET_START = r"(?U)^\s*(?:[•·–—*▪◦‣]|-\s|\(\d+\)|\d+[.)])\s*"
BULLET_SPLIT = r"(?U)\s+(?=[•·–—*▪◦‣]\s|\(\d+\)\s|\d+[.)]\s|-\s)"
BLANK_LINE = r"(?U)\n\s*\n"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
EMPTY_BODY = '<p class="muted">No extractable text on these pages — see the page images below.</p>'
HEADER_WARNING = (
    " * Heuristic extraction: VERIFY every address, width and bit position against",
    " * the datasheet before using in production. */",
)
SVD_WARNING = "Heuristic — verify against the datasheet."
SVD_DEVICE = '<device schemaVersion="1.3" xmlns:xs="http://www.w3.org/2001/XMLSchema-instance" xs:noNamespaceSchemaLocation="CMSIS-SVD.xsd">'
# ------------------------------------------------------------------------------------------------

# What a language model is told and asked.  Fixed by the prompt's format: its parts around title and text, and the mark of a cut.
PROMPT = ("Datasheet section title: ", '\n\nSection text:\n"""\n', '\n"""\n\n')
PROMPT_CUT = "\n...[truncated]..."
PROMPT_CHARS = 8000
# Our own wording.
SYSTEM = (
    "You explain one section of a device's documentation to developers, briefly and only by what the section says. "
    "Names of registers and bits, and addresses, are taken from the section; none are made up."
)
ANSWER_SHAPE = """{"summary": "what the section is about, two to four sentences of at most 80 words in all",
 "keywords": ["a few words to search by"],
 "registers": [{"name": "as written", "description": "one line", "address": "such as 0x25, or empty",
                "fields": [{"bits": "such as 7 or 3:0", "name": "as written", "access": "such as R/W, or empty", "description": "one line"}]}],
 "code_examples": [{"title": "a few words", "language": "c, asm or python", "code": "the program text"}]}"""
INSTRUCTIONS = (
    "Answer with one JSON object and nothing around it. All four keys are there, in this shape:\n" + ANSWER_SHAPE + "\n"
    "List registers and fields only where the section describes them, else an empty list. Give one short program "
    "where the section is about something that a developer programs, else an empty list."
)
